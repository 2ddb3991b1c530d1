"""Text expressions: ids, whitespace, HTML to plain text, truncation."""

from pyspark.sql import Column, DataFrame, functions as F

from tidings import fixed_values as fv
from tidings.functions.entities import decode_entities


def url_id(url: Column) -> Column:
    """Item id: the first 16 hex digits of the SHA-1 of the UTF-8 URL."""
    return F.substring(F.sha1(F.encode(url, "UTF-8")), 1, 16)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (`trim` alone only knows the space)."""
    return F.btrim(text, F.lit(fv.WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(fv.WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# --- HTML to text, one step each --------------------------------------------------------------

def drop_comments(html: Column) -> Column:
    return F.regexp_replace(html, fv.HTML_COMMENT, "")


def mark_list_items(html: Column) -> Column:
    return F.regexp_replace(html, fv.HTML_LIST_ITEM, "\n- ")


def mark_line_breaks(html: Column) -> Column:
    return F.regexp_replace(html, fv.HTML_LINE_BREAK, "\n")


def drop_tags(html: Column) -> Column:
    return F.regexp_replace(html, fv.HTML_TAG, "")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]+", " ")


def strip_lines(text: Column) -> Column:
    """Strip each line. Several times faster than a pattern that looks for blanks at line ends."""
    return F.array_join(F.transform(F.split(text, "\n", -1), strip), "\n")


def collapse_blank_lines(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def markup_to_text(html: Column) -> Column:
    """The markup half: comments, list items, line breaks, remaining tags."""
    return drop_tags(mark_line_breaks(mark_list_items(drop_comments(html))))


def tidy_whitespace(text: Column) -> Column:
    """The whitespace half: space runs, line ends, blank lines."""
    return collapse_blank_lines(strip_lines(collapse_spaces(text)))


def truncate_text(text: Column, max_chars: int = fv.SUMMARY_MAX_CHARS) -> Column:
    """Cut an overlong text at its last line, else at its last space, else hard; add an ellipsis.

    `n - 1 - length(substring_index(head, c, -1))` is the zero-based position of the last `c` in
    the head of n characters, and -1 when there is none. `text` should be a plain column: it is
    referenced several times.
    """
    head = F.substring(text, 1, max_chars)

    def last(c: str) -> Column:
        return F.lit(max_chars - 1) - F.length(F.substring_index(head, c, -1))

    at_line, at_space = last("\n"), last(" ")
    cut = (F.when(at_line >= max_chars * fv.SUMMARY_MIN_CUT, at_line)
           .when(at_space > 0, at_space)
           .otherwise(F.lit(max_chars)))
    shortened = F.concat(rstrip(text.substr(F.lit(1), cut)), F.lit(fv.ELLIPSIS))
    return F.when(F.length(text) > max_chars, shortened).otherwise(text)


def with_plain_text(df: DataFrame, source: str, target: str,
                    max_chars: int | None = fv.SUMMARY_MAX_CHARS) -> DataFrame:
    """Add `target`: the HTML column `source` as readable plain text, null and empty -> "".

    The steps are staged as columns because entity decoding and truncation read their input
    several times; Catalyst keeps such stages apart instead of repeating the regex chain. No step
    shuffles or leaves the JVM.
    """
    staged = f"__{target}"
    df = df.withColumn(staged, markup_to_text(F.coalesce(F.col(source), F.lit(""))))
    df = df.withColumn(staged, decode_entities(F.col(staged)))
    df = df.withColumn(staged, tidy_whitespace(F.col(staged)))
    text = F.col(staged)
    result = text if max_chars is None else truncate_text(text, max_chars)
    return df.withColumn(target, result).drop(staged)


def clean_title(html: Column) -> Column:
    """Light cleaning for link titles: comments, tags, entities, strip."""
    return strip(decode_entities(drop_tags(drop_comments(html))))


def drop_trailer_lines(text: Column, names: list[str] = fv.TRAILER_NAMES) -> Column:
    """Drop the lines that are commit trailers, then strip."""
    trailer = r"(?iu)\A(?:" + "|".join(names) + "):"
    kept = F.filter(F.split(text, "\n", -1), lambda line: ~strip(line).rlike(trailer))
    return strip(F.array_join(kept, "\n"))
