"""Text functions: token windows, markup removal, hashes, names, JSON and time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import markup

BLANKS = "[ \\t\\n\\r]+"


def tokens(text: Column) -> Column:
    return F.split(text, BLANKS)


def window_starts(n: Column, size: int, overlap: int) -> Column:
    stride = size - overlap
    if stride <= 0:
        raise ValueError("a window must be longer than the overlap")
    return F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride))


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def chunks(text: Column, size: int, overlap: int = 10, tokenize: Callable[[Column], Column] = tokens, detokenize: Callable[[Column], Column] = joined) -> Column:
    """Overlapping token windows. At most `size` tokens: the text itself; the last windows may lie inside the one before.

    tokenize makes an array of a text, detokenize a text of such an array: functions of columns, built-in ones or
    a tokenizer's in a Pandas UDF. A null text is one null chunk.
    """

    def cut(words: Column) -> Column:
        parts = F.transform(window_starts(F.size(words), size, overlap), lambda s: detokenize(F.slice(words, s + 1, F.lit(size))))
        return F.when(F.size(words) <= size, F.array(text)).otherwise(parts)

    # the words are bound once, as the element of a one-row array, and not split anew for each window
    return F.element_at(F.transform(F.array(tokenize(text)), cut), 1)


def escape_markup(text: Column) -> Column:
    """Text that strip_markup gives back as it was."""
    for name, char in reversed(markup.ENTITIES):
        if char != " ":
            text = F.replace(text, F.lit(char), F.lit(name))
    return text


def strip_markup(text: Column) -> Column:
    """Plain text of wiki markup; one level of XML entities is decoded."""
    return markup.strip_markup(text)


def source_of(name: Column) -> Column:
    """The source code before the first dash of a file name; unknown codes are null."""
    code = F.split_part(name, F.lit("-"), F.lit(1))
    return F.when(code.isin("enwiki", "frwiki"), code)


def https_url(url: Column, host_from: str = "http://", host_to: str = "https://") -> Column:
    return F.replace(url, F.lit(host_from), F.lit(host_to))


def file_name(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def safe_name(title: Column) -> Column:
    return F.regexp_replace(title, '[\\\\/:"*?<>|]+', "_")


def iso_timestamp(text: Column) -> Column:
    """Null where there is no valid time."""
    return F.try_to_timestamp(text)


def json_text(json: Column, key: str) -> Column:
    return F.get_json_object(json, f"$.{key}")


def to_message(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
