"""Text and path expressions. Offsets are code points; nulls give nulls unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The usual cut-off of trigram similarity.
TRIGRAM_THRESHOLD = 0.3
AUDIO_FILE = r"(?i)\.(mp3|m4a|m4b|ogg|flac|aac|wma|wav)$"
APPLE_DOUBLE = r"(^|/)\._[^/]*$"


def book_dir(path: Column) -> Column:
    """A track's book: its path without the last component; a path without a slash is its own book."""
    return F.regexp_replace(path, r"/[^/]+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def is_audio_file(path: Column) -> Column:
    """One of eight extensions in any case, but no resource fork."""
    return path.rlike(AUDIO_FILE) & ~path.rlike(APPLE_DOUBLE)


def like_escape(text: str) -> str:
    """text with the wildcards of LIKE escaped by a backslash."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_wild(column: Column, query: str) -> Column:
    """Case-insensitive substring match in which % and _ of the query stay wildcards."""
    return column.ilike(f"%{query}%")


def contains_exact(column: Column, query: str) -> Column:
    """Case-insensitive substring match in which the query stands for itself."""
    return F.contains(F.lower(column), F.lit(query.lower()))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case words, each with two spaces before it and one after. A word that comes again
    is cut once."""
    parts = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != ""))
    padded = F.transform(parts, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams of two texts over all their trigrams, 0 if neither has any."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(both / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def normalised(text: Column) -> Column:
    """Lower case, letters and digits only, one space for every other run, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "))


# The two forms of a catalogue number.
def asin(text: Column) -> Column:
    """The catalogue number in square brackets, upper case; null if there is none."""
    return F.nullif(F.regexp_extract(F.upper(text), r"\[((?:B0[0-9A-Z]{8})|(?:[0-9]{6,}))\]", 1), F.lit(""))


def without_asin(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?i)\s*\[((?:B0[0-9A-Z]{8})|(?:[0-9]{6,}))\]", ""))


# What a number at the end of a track's name may follow.
TRAILING_TRACK = r"(?i)[\s_]*[-–—]?[\s_]*(?:track|part|chapter|chp|pt|disc|cd|vol|volume)?[\s_]*[0-9]+\s*\z"


def title_from_path(path: Column) -> Column:
    """A file's name without its extension and a track, part or disc number at its end; with it if nothing else is left."""
    stem = F.regexp_replace(basename(path), r"(?s)(?<=.)\.[^.]*\z", "")
    bare = F.regexp_replace(F.trim(F.regexp_replace(stem, TRAILING_TRACK, "")), r"[ \-–—_]+\z", "")
    return F.when(bare == "", F.trim(stem)).otherwise(bare)


def author_and_title(path: Column, roots: list[str]) -> Column:
    """Author and title from the first two components under the longest root, else the last two directories."""
    picked = F.lit(None).cast("array<string>")
    for root in sorted(roots, key=len):
        rest = F.split(F.substr(path, F.lit(len(root.rstrip("/")) + 2)), "/")
        picked = F.when(path.startswith(root.rstrip("/") + "/") & (F.size(rest) >= 3), F.slice(rest, 1, 2)).otherwise(picked)
    parts = F.split(book_dir(path), "/")
    last = F.when(F.size(parts) >= 2, F.slice(parts, -2, 2)).otherwise(F.array(F.lit(""), F.element_at(parts, -1)))
    chosen = F.coalesce(picked, last)
    return F.struct(chosen[0].alias("author"), without_asin(chosen[1]).alias("title"))


def series_refs(text: Column) -> Column:
    """[{name, sequence}] of "Name #2, Other #1.5": the last # splits, nameless parts are dropped, none gives null."""
    part = lambda x: F.trim(x)
    split = lambda x: F.struct(
        F.trim(F.when(F.contains(x, F.lit("#")), F.regexp_extract(x, r"^(.*)#[^#]*$", 1)).otherwise(x)).alias("name"),
        F.when(F.contains(x, F.lit("#")), F.trim(F.regexp_extract(x, r"#([^#]*)$", 1))).otherwise(F.lit("")).alias("sequence"),
    )
    refs = F.filter(F.transform(F.split(text, ","), lambda x: split(part(x))), lambda r: r["name"] != "")
    return F.when(F.size(refs) > 0, refs)


def sequence_order(sequence: Column) -> list[Column]:
    """Sort keys of a series' sequence: empty last, numbers by value before other text."""
    number = sequence.try_cast("double")
    return [(sequence == "").asc(), number.isNull().asc(), number.asc(), sequence.asc()]


def snippet(text: Column, query: str | None, most: int = 200) -> Column:
    """A text of over most characters as at most so many: around the first match of query, in any case, or from its start.

    The window is cut at spaces (no other white space): its start moves behind the next space, its end to the last one.
    Where nothing is left, such as in one long word, it is the text's first characters. An ellipsis stands for what is cut
    at either end, and white space there goes."""
    n, asked = F.length(text), query or ""
    at = F.locate(asked.lower(), F.lower(text)) if asked else F.lit(0)
    centred = F.when(at > 0, F.greatest(F.lit(0), at - 1 - int((most - len(asked)) / 2))).otherwise(0)
    start = F.least(centred, n - most)
    whole = F.substring(text, start + 1, F.lit(most))
    ahead = F.when(start > 0, F.regexp_replace(whole, r"^[^ ]* *", "")).otherwise(whole)
    cut_end = start + most < n
    kept = F.when(cut_end, F.regexp_replace(ahead, r"[^ ]*\z", "")).otherwise(ahead)
    nothing = kept == ""
    trimmed = F.regexp_replace(F.when(nothing, F.substring(text, 1, most)).otherwise(kept), r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+\z", "")
    shown = F.concat(F.when((start > 0) & ~nothing, "…").otherwise(""), trimmed, F.when(cut_end | nothing, "…").otherwise(""))
    return F.when(n <= most, text).otherwise(shown)


def around(text: Column, start: Column, end: Column, each: int = 220) -> Column:
    """The characters around a span from start to before end, with whether something was cut."""
    low = F.greatest(F.lit(0), start - each)
    high = F.least(F.length(text), end + each)
    return F.struct(F.substring(text, low + 1, high - low).alias("context"), ((low > 0) | (high < F.length(text))).alias("truncated"))


def outer_json(text: Column) -> Column:
    """From the first { to the last }, or an empty text."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def sanitised(text: Column, most: int = 200) -> Column:
    """Control characters as spaces, trimmed and cut."""
    return F.substring(F.trim(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")), 1, most)


def model_size(name: Column) -> Column:
    """The size in a model's name, such as 0.6B; null if it has none."""
    return F.nullif(F.upper(F.regexp_extract(name, r"(?i)(?:^|[-_:])([0-9]+(?:\.[0-9]+)?b)(?:$|[-_.:])", 1)), F.lit(""))


def parsed_path(path: Column) -> Column:
    """{author, title, chapter_index, chapter_name} of a path as it was once laid out: the author follows the directory
    "audiobooks"; a file's name is "title - number - chapter", else the title is the directory after the author."""
    parts, name = F.split(path, "/"), F.regexp_replace(basename(path), r"(?s)\.[^.]*\z", "")
    at = F.array_position(parts, "audiobooks")
    author = F.when((at > 0) & (at < F.size(parts)), F.get(parts, at.cast("int"))).otherwise("")
    pieces = F.split(name, " - ")
    n = F.size(pieces)
    index = F.when(F.get(pieces, n - 2).rlike(r"^[+-]?[0-9]+\z"), F.get(pieces, n - 2).try_cast("int"))
    bare = lambda t: F.when(F.contains(t, F.lit("[")), F.trim(F.substring_index(t, "[", 1))).otherwise(t)
    after = F.when(author != "", F.call_function("substring_index", path, author, F.lit(-1))).otherwise(F.lit(""))
    below = F.get(F.split(F.substr(after, F.lit(2)), "/"), F.lit(0))
    from_dir = F.when(below == "metadata.json", "").otherwise(bare(F.coalesce(below, F.lit(""))))
    whole, none = F.size(parts) >= 3, F.lit("")
    return F.struct(
        F.when(whole, author).otherwise(none).alias("author"),
        F.when(whole & (n >= 3), bare(F.array_join(F.slice(pieces, 1, F.greatest(n - 2, F.lit(0))), " - "))).when(whole, from_dir).otherwise(none).alias("title"),
        F.when(whole & (n >= 3), F.coalesce(index, F.lit(0))).otherwise(0).alias("chapter_index"),
        F.when(whole & (n >= 3), F.get(pieces, n - 1)).otherwise(none).alias("chapter_name"),
    )
