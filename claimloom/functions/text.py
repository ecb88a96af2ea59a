"""Text functions as column expressions; none of them runs Python on executors.

White space and word characters follow Unicode, as the `(?U)` flag of the JVM has them.
Null texts give null, or empty arrays.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(column: Column, phrases: list[str]) -> Column:
    """Whether one of the phrases stands in the column."""
    return column.rlike("|".join(re.escape(p) for p in phrases))


def let(value: Column, then) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def strip(c) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def lines(c) -> Column:
    """The lines of a text, at any of Unicode's line breaks."""
    return F.split(_col(c), "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]")


def squeezed(c) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return strip(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def empty_as_null(c) -> Column:
    return F.when(_col(c) != "", _col(c))


def chunks(c, most: int = V.CHUNK_CHARS) -> Column:
    """Stripped non-blank lines packed greedily, in order, into chunks of at most `most`
    characters; a longer line is a chunk of its own. A chunk but the first counts its first
    line without the separator."""
    stripped = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("n"))

    def add(s: Column, line: Column) -> Column:
        full = s["now"].isNotNull() & (s["n"] + F.length(line) + 1 > most)
        return F.struct(
            F.when(full, F.array_append(s["done"], s["now"])).otherwise(s["done"]).alias("done"),
            F.when(full | s["now"].isNull(), line).otherwise(F.concat(s["now"], F.lit(" "), line)).alias("now"),
            F.when(full, F.length(line)).otherwise(s["n"] + F.length(line) + 1).alias("n"),
        )

    return F.aggregate(stripped, start, add, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["now"])))


def topic_lines(c) -> Column:
    """Topic phrases of a model's answer: bullets and numbers stripped, 2 to 8 words."""
    bare = F.transform(lines(c), lambda x: strip(F.regexp_replace(x, r"^[ •\-*0-9.]+|[ •\-*0-9.]+$", "")))
    return F.filter(bare, lambda x: (x != "") & ~_any(F.lower(x), V.TOPIC_JUNK) & F.size(F.split(squeezed(x), " ")).between(2, 8))


def subtopics(c) -> Column:
    """Subtopics of a model's answer: leading bullets stripped, 3 characters and up to 8 words,
    the first of those that differ in case only."""
    bare = F.transform(F.split(_col(c), "\n"), strip)
    kept = F.filter(bare, lambda x: (x != "") & ~F.lower(x).contains("note:"))
    named = F.transform(kept, lambda x: strip(F.regexp_replace(x, r"^[\-•*0-9. ]+", "")))
    good = F.filter(named, lambda x: (F.length(x) >= 3) & (F.size(F.split(squeezed(x), " ")) <= 8))
    lower = F.transform(good, F.lower)
    return F.filter(good, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def sentences(c) -> Column:
    """Sentences between . ? and !, of 10 characters or more."""
    flat = F.regexp_replace(_col(c), "\n", " ")
    return F.filter(F.transform(F.split(flat, "[.?!]"), strip), lambda x: F.length(x) >= 10)


def tokens(c, stopwords: list[str]) -> Column:
    """Distinct tokens of over two characters that are no stopwords."""
    found = F.regexp_extract_all(F.lower(_col(c)), F.lit("([a-z0-9]+(?:-[a-z0-9]+)*)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) > 2) & ~x.isin(*stopwords)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a, b) -> Column:
    """Shared part of two token sets; 0 if one is empty."""
    share = lambda a, b: F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    return let(F.struct(_col(a).alias("a"), _col(b).alias("b")), lambda x: share(x["a"], x["b"]))


def unquoted(c) -> Column:
    """Without white space, then quotes, then white space at both ends."""
    return strip(F.regexp_replace(strip(c), f"^[{V.QUOTES}]+|[{V.QUOTES}]+$", ""))


def triple(c) -> Column:
    """(subj, rel, obj) that a statement says, or null. The first relation in order that is
    found decides; what it leaves is not tried with others."""

    def first(bare: Column) -> Column:
        out = F.lit(None).cast("struct<subj:string,rel:string,obj:string>")
        for rel, words in reversed(V.RELATIONS):
            pattern = rf"(.+?)\s+{words}\s+(.+)"
            part = lambda i: unquoted(F.regexp_extract(bare, pattern, i))  # noqa: E731, B023
            # a character on each side is all that the pattern needs, and is found in one pass
            out = F.when(bare.rlike(rf".\s+{words}\s+."), F.struct(part(1).alias("subj"), F.lit(rel).alias("rel"), part(2).alias("obj"))).otherwise(out)
        return out

    def good(t: Column) -> Column:
        starts = t["subj"].rlike("^(?:" + "|".join(V.QUESTION_STARTS) + ")")
        return F.when((F.length(t["subj"]) >= 3) & (F.length(t["obj"]) >= 3) & ~starts, t)

    told = lambda low: F.when(~_any(low, V.INSTRUCTIONS), let(F.regexp_replace(low, r"\.+$", ""), lambda bare: let(first(bare), good)))
    return let(F.lower(strip(c)), told)


def relation_family(c) -> Column:
    normal = F.regexp_replace(squeezed(F.lower(F.coalesce(_col(c), F.lit("")))), "-", "_")
    families = F.create_map(*[F.lit(x) for kv in V.RELATION_FAMILIES.items() for x in kv])
    return F.coalesce(families[normal], normal)


def claim_surface(c, is_object: bool = False) -> Column:
    """A claim's subject or object in normal form."""

    def head(x: Column) -> Column:
        out = x
        for marker in reversed(V.CLAUSE_MARKERS):
            before = strip(F.substring_index(x, marker, 1))
            out = F.when(x.contains(marker) & (before != ""), before).otherwise(out)
        return out

    cut = let(strip(F.lower(F.coalesce(_col(c), F.lit("")))), head)
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, "_", " "), r"[\-/]+", " "), r"(?U)[^\w\s]", " ")
    for pattern, new in V.REWRITES:
        cut = F.regexp_replace(cut, "(?U)" + pattern, new)
    cut = squeezed(cut)
    cut = F.regexp_replace(cut, "^(?:" + "|".join(V.LEADING_PHRASES) + ")+", "")
    cut = strip(F.regexp_replace(cut, r"^(?:the|a|an)\s+", ""))
    if is_object:
        cut = F.regexp_replace(cut, "^(?:" + "|".join(V.META_OBJECTS) + ")+", "")
    return squeezed(cut)


def claim_signature(c, is_object: bool = False) -> Column:
    """The sorted distinct tokens of the normal form."""
    words = F.filter(F.split(claim_surface(c, is_object), " "), lambda x: (x != "") & ~x.isin(*V.CLAIM_STOPWORDS))
    return F.array_sort(F.array_distinct(words))


def shortened(c, most: int = 180) -> Column:
    return let(squeezed(c), lambda x: F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x))


def run_slug(c, most: int = 60) -> Column:
    """The folder name of a run: ASCII, `doc` if nothing is left."""
    x = F.regexp_replace(strip(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " "), "[^a-z0-9 _-]+", "")), " ", "_")
    return F.when(x == "", "doc").otherwise(F.substring(x, 1, most))


def focus_slug(c, most: int = 80) -> Column:
    """The file name of a focus: letters and digits of any script, `focus` if nothing is left."""
    x = F.regexp_replace(strip(F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N} _-]", "")), " ", "_")
    return F.when(x == "", "focus").otherwise(F.substring(x, 1, most))


def clean_label(c) -> Column:
    x = _col(c)
    for junk in V.LABEL_JUNK:
        x = F.replace(x, F.lit(junk), F.lit(""))
    return strip(x)


def hover_label(c, most: int = 96) -> Column:
    return strip(F.substring(squeezed(F.replace(F.coalesce(_col(c), F.lit("")), F.lit("_"), F.lit(" "))), 1, most))


def is_code(c) -> Column:
    """Whether a focus looks like code."""
    return F.lower(strip(c)).rlike(V.CODE_FOCUS)


def content_id(c) -> Column:
    return F.substring(F.sha2(_col(c).cast("binary"), 256), 1, 12)


def path_text(path) -> Column:
    return F.concat_ws(" → ", _col(path))


def claim_text(src, rel, dst) -> Column:
    return F.concat(_col(src), F.lit(" —"), _col(rel), F.lit("→ "), _col(dst))


def topic_prompt(chunk, k: int = V.TOPICS_PER_CHUNK) -> Column:
    return F.concat(F.lit(f"Name {k} short topics, of 3 to 8 words, that this excerpt is about. One on a line, nothing else.\n\n"), _col(chunk))


def subtopic_prompt(topic, k: int = 10) -> Column:
    return F.concat(F.lit(f"Name {k} subtopics of the topic below. One on a line, nothing else.\n\n"), _col(topic))


def question_prompt(path, guide: str = "", k: int = V.QUESTIONS) -> Column:
    told = f"\n\nThe document, in short: {guide}" if guide else ""
    return F.concat(F.lit(f"Ask {k} different questions about causes and effects within: "), path_text(path), F.lit(f"{told}\n\nOne on a line, nothing else."))


def statement_prompt(question, path, guide: str = "", k: int = V.STATEMENTS) -> Column:
    told = f"\nThe document, in short: {guide}" if guide else ""
    return F.concat(F.lit(f"Answer with {k} sentences, each on a line, that name a cause and its effect.\nTopic: "), path_text(path), F.lit(f"{told}\nQuestion: "), _col(question))
