"""Files of comments, payloads and pages: identity of files, and files that cannot be read."""

import json

import pytest

from textshield.sources.comments import read_comment_payload, read_comments, read_pages, unreadable_files


@pytest.fixture
def folder(tmp_path):
    for name, entries in (("a", [{"id": "1", "body": "x"}, {"id": "1", "body": "y"}]), ("deep/b", [{"id": "2", "body": "z"}]), ("c", None)):
        path = tmp_path / f"{name}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps({"results": entries} if entries else {"_links": {"base": "x"}}, indent=2))
    return tmp_path


def rows(found):
    return sorted((r.path.rsplit("/", 1)[-1], r.pos, r.id, r.body) for r in found.collect())


WANT = [("a.json", 0, "1", "x"), ("a.json", 1, "1", "y"), ("b.json", 0, "2", "z")]


def test_files_are_told_apart(spark, folder):
    assert rows(read_comments(spark, str(folder))) == WANT
    assert unreadable_files(spark, str(folder)).count() == 0


def test_files_that_are_no_json(spark, folder):
    (folder / "broken.json").write_text('{"results": [{"id": "3", "bo')
    (folder / "empty.json").write_text("")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        read_comments(spark, str(folder)).collect()
    assert rows(read_comments(spark, str(folder), "PERMISSIVE")) == WANT
    assert [r.path.rsplit("/", 1)[-1] for r in unreadable_files(spark, str(folder)).collect() if "broken" in r.path] == ["broken.json"]


def test_a_missing_file_is_an_error(spark, tmp_path):
    for read in (read_comments, read_comment_payload, read_pages):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            read(spark, str(tmp_path / "none"))


def test_payloads_and_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"id": "1", "status": "current", "body": {"storage": {"value": "<p>a</p>"}}}, {"id": "2"}]}))
    assert rows(read_comment_payload(spark, str(tmp_path))) == [("p.json", 0, "1", "a"), ("p.json", 1, "2", "")]
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "1.json").write_text(json.dumps({"title": "T", "version": {"number": 3}}))
    page = read_pages(spark, str(pages)).first()
    assert (page.path[-6:], page.title, page.space_name, page.version, page.html) == ("1.json", "T", "Unknown", "3", "")
