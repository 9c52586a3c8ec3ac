"""Text columns: markup, addresses, previews, keywords and change metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textshield.fixed_values import BLOCKED_FORMAT, BLOCKED_PREFIX, FILTER_KEYWORDS, SPACE, WIKI_PAGE_URL
from textshield.functions.vectors import let


def strip_html(html: Column) -> Column:
    """Delete tags. A tag ends on its own line; script bodies and entities stay.

    ``(?d)`` makes the dot stop at a line feed only, not at other line terminators.
    """
    return F.regexp_replace(html, "(?d)<.*?>", "")


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, f"\\A[{SPACE}]+|[{SPACE}]+\\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE}]")


def page_ref(url: Column, pattern: str = WIKI_PAGE_URL) -> Column:
    """``struct<base_url, space_key, page_id>`` of a page address, all null when it is none.

    ``pattern`` is matched from the start and names the three parts as groups 1 to 3.
    """
    found = url.rlike(pattern)
    names = ("base_url", "space_key", "page_id")
    return F.struct(*[F.when(found, F.regexp_extract(url, pattern, i + 1)).alias(n) for i, n in enumerate(names)])


def preview(text: Column, n: int, ellipsis: str = "...") -> Column:
    """The first ``n`` characters, marked when something was left out."""
    head = F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(head, F.lit(ellipsis))).otherwise(text) if ellipsis else head


def filtered_keywords(text: Column, keywords: Sequence[str] = FILTER_KEYWORDS) -> Column:
    """Keywords contained in a text, ignoring case, in the order of the list."""
    hits = lambda lowered: [F.when(F.contains(lowered, F.lit(k.lower())), F.lit(k)) for k in keywords]
    none = F.array().cast("array<string>")
    return let(F.lower(text), lambda lowered: F.array_compact(F.array(*hits(lowered)))) if keywords else none


def _percent(x: Column) -> Column:
    """Two decimals; halves go to the even neighbour."""
    return F.rint(x * 100.0) / 100.0


def rewrite_metrics(original: Column, rewritten: Column, keywords: Sequence[str] = FILTER_KEYWORDS) -> Column:
    """Lengths, change flag, keywords of the original and the reduction in percent."""
    before, after = F.length(original), F.length(rewritten)
    ratio = after.cast("double") / before.cast("double")
    return F.struct(
        before.alias("original_length"),
        after.alias("rewritten_length"),
        (original != rewritten).alias("changes_made"),
        filtered_keywords(original, keywords).alias("filtered_keywords"),
        F.when(before > 0, _percent(100.0 * (1.0 - ratio))).otherwise(0.0).alias("reduction_percentage"),
        F.lit(None).cast("string").alias("error"),
    )


def rewrite_error(original: Column, error: Column) -> Column:
    """The metrics of a rewrite that failed: nothing changed, the error is kept."""
    return F.struct(
        F.length(original).alias("original_length"),
        F.length(original).alias("rewritten_length"),
        F.lit(False).alias("changes_made"),
        F.array().cast("array<string>").alias("filtered_keywords"),
        F.lit(0.0).alias("reduction_percentage"),
        error.alias("error"),
    )


def blocked_marker(label: Column) -> Column:
    return F.format_string(BLOCKED_FORMAT, label)


def is_valid(text: Column) -> Column:
    """A text is valid unless it is the marker of a blocked one."""
    return ~F.startswith(text, F.lit(BLOCKED_PREFIX))


def word_split(text: Column) -> Column:
    """Lower-case words (letters and digits of any script) in order, with empty strings at the edges."""
    return F.split(F.lower(text), r"[^\p{L}\p{Nd}]+")


def words(text: Column) -> Column:
    return F.filter(word_split(text), lambda w: w != "")
