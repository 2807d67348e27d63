"""Files to numbered lines, as the scanner reads them.

All of it happens within the row of a file, so no line is shuffled: which lines are skipped and which line comes
before each follows from arrays of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import paths
from sieveline.functions.strings import strip

#: Longer lines, in bytes, are data and not scanned.
LONGEST = 4096
COMMENTS = ("//", "#", "/*", "<!--")
LOG_WORDS = "bearer |authorization:"


def split_lines(content: Column) -> Column:
    """Lines without their ends, \\n or \\r\\n; no empty line after a last \\n."""
    each = F.transform(F.split(content, "\n"), lambda x: F.when(F.endswith(x, F.lit("\r")), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x))
    return F.when(content == "", F.slice(each, 1, 0)).when(F.endswith(content, F.lit("\n")), F.slice(each, 1, F.size(each) - 1)).otherwise(each)


def numbered(files: DataFrame, content: str = "content") -> DataFrame:
    """All columns but the content, line_no from 1 and raw, one row a line."""
    keep = [c for c in files.columns if c != content]
    return files.select(*keep, F.posexplode(split_lines(F.col(content))).alias("at", "raw")).select(*keep, (F.col("at") + 1).alias("line_no"), "raw")


def uncomment(trim: Column) -> Column:
    """A trimmed line without // or # at its start."""
    return F.when(F.startswith(trim, F.lit("//")), strip(trim.substr(F.lit(3), F.length(trim)))).when(F.startswith(trim, F.lit("#")), strip(trim.substr(F.lit(2), F.length(trim)))).otherwise(trim)


def scanned_at(trims: Column, marker: str, comments: tuple[str, ...] = COMMENTS) -> Column:
    """Positions of the lines that are scanned. Lines over LONGEST are passed over as if they were not there. A line with the marker
    is not scanned; if it is a comment, nor is the next, which then arms nothing. So a line after a run of marked comments
    is skipped if the run is odd."""
    all_at = F.filter(F.sequence(F.lit(0), F.size(trims) - 1), lambda i: (i >= 0) & (F.octet_length(F.get(trims, i)) <= LONGEST))
    at = F.when(F.size(trims) > 0, all_at).otherwise(F.array().cast("array<int>"))
    if not marker:
        return at
    arms = lambda t: t.contains(marker) & t.rlike(r"\A" + paths.any_of(comments))
    # places among the lines that count, of those that arm nothing
    plain = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda k: (k >= 0) & (k < F.size(at)) & ~arms(F.get(trims, F.get(at, k))))
    before = F.concat(F.array(F.lit(-1)), F.slice(plain, 1, F.greatest(F.size(plain) - 1, F.lit(0))))
    even = F.zip_with(plain, F.slice(before, 1, F.size(plain)), lambda k, b: F.when((k - b - 1) % 2 == 0, F.get(at, k)))
    kept = F.filter(even, lambda i: i.isNotNull() & ~F.get(trims, i).contains(marker))
    return F.when(F.exists(trims, lambda t: t.contains(marker)), kept).otherwise(at)


def scanned(files: DataFrame, marker: str, content: str = "content", comments: tuple[str, ...] = COMMENTS) -> DataFrame:
    """All columns but the content, has_footer, and for each scanned line line_no, raw, trim (without comment signs) and prev,
    the trim of the scanned line before it, null for the first. has_footer: some line, even a skipped one, starts -----END."""
    keep = [c for c in files.columns if c != content]
    some = files.select(*keep, split_lines(F.col(content)).alias("raws"))
    some = some.select(*keep, "raws", F.transform("raws", strip).alias("trims"))
    some = some.select(*keep, "raws", "trims", F.exists("trims", lambda t: F.startswith(t, F.lit("-----END "))).alias("has_footer"), scanned_at(F.col("trims"), marker, comments).alias("at"))
    rows = F.transform("at", lambda i, k: F.struct((i + 1).alias("line_no"), F.get("raws", i).alias("raw"), uncomment(F.get("trims", i)).alias("trim"), uncomment(F.get("trims", F.get("at", k - 1))).alias("prev")))
    return some.select(*keep, "has_footer", F.inline(rows))


def is_log(trim: Column) -> Column:
    return (F.octet_length(trim) >= 30) & F.lower(trim).rlike(LOG_WORDS)


def may_log(content: Column) -> Column:
    """Whether some line may be one of a log."""
    low = F.lower(content)
    first, second = LOG_WORDS.split("|")
    return F.contains(low, F.lit(first)) | F.contains(low, F.lit(second))


def file_flags(path: Column) -> list[Column]:
    return [paths.is_source(path).alias("is_source"), paths.is_netrc(path).alias("is_netrc"), paths.without_entropy(path).alias("no_entropy"), paths.is_test_path(path).alias("is_test")]
