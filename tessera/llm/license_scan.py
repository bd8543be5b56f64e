"""Fuzzy search for short licence notices.

A notice that stands in a text with at most k edits contains at least one of the notice's
k + 1 pieces unchanged (pigeonhole). All pieces of all notices are looked up at once by an
Aho-Corasick automaton; around each hit, a window of the notice's length plus k on either
side is verified by the regex library's bounded-error matching, which gives the span and its
edits. Parts of a notice that tell licences apart (version numbers, short names) allow none.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import map_texts


@dataclass(frozen=True)
class Notice:
    label: str
    #: Words joined by a space. Words in braces allow no edits.
    phrase: str
    base: bool = False


# The base phrases with their labels, then notices as the licences word them.
NOTICES = (
    Notice("mit", "under the {mit} license", base=True),
    Notice("apache-2", "apache license version {2}", base=True),
    Notice("cc-by-nc", "{cc by nc}", base=True),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("apache-2", "licensed under the apache license version {2}"),
    Notice("gpl-2", "gnu general public license version {2}"),
    Notice("gpl-3", "gnu general public license version {3}"),
    Notice("lgpl", "gnu lesser general public license"),
    Notice("agpl-3", "gnu affero general public license version {3}"),
    Notice("mpl-2", "mozilla public license version {2}"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Notice("cc-by", "creative commons attribution {4 0} international license"),
    Notice("cc-by-sa", "{cc by sa}"),
    Notice("cc-by-nd", "{cc by nd}"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
    Notice("proprietary", "all rights reserved no part of this"),
)

#: One edit for so many characters that allow them, and no more than MOST_EDITS.
CHARS_AN_EDIT = 10
MOST_EDITS = 3
#: A-Z to lower case; everything but digits, letters and bytes of other scripts to a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Pattern:
    notice: Notice
    plain: str
    edits: int
    pieces: tuple[tuple[int, str], ...]


def pattern(notice: Notice) -> Pattern:
    plain = notice.phrase.replace("{", "").replace("}", "")
    free = "".join(part.split("}")[-1] for part in notice.phrase.split("{"))
    edits = min(MOST_EDITS, len(free.strip()) // CHARS_AN_EDIT)
    cuts = [round(i * len(plain) / (edits + 1)) for i in range(edits + 2)]
    return Pattern(notice, plain, edits, tuple((a, plain[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)))


def matcher(p: Pattern):
    """The regular expression of a notice: its free stretches share the edits."""
    import regex

    out, rest = "", p.notice.phrase
    free_parts = []
    while rest:
        if rest.startswith("{"):
            exact, _, rest = rest[1:].partition("}")
            out += regex.escape(exact)
        else:
            free, brace, after = rest.partition("{")
            rest = brace + after
            free_parts.append(free)
            out += f"(?:{regex.escape(free)}){{e<={p.edits}}}" if p.edits else regex.escape(free)
    return regex.compile(rf"(?<![^ ]){out}(?![^ ])", regex.BESTMATCH)


@lru_cache(maxsize=4)
def compiled(notices: tuple[Notice, ...]):
    import ahocorasick

    patterns = [(p := pattern(n), matcher(p)) for n in notices]
    seeds: dict[str, list[tuple[int, int]]] = {}
    for k, (p, _) in enumerate(patterns):
        for offset, piece in p.pieces:
            seeds.setdefault(piece, []).append((k, offset))
    automaton = ahocorasick.Automaton()
    for piece, owners in seeds.items():
        automaton.add_word(piece, (len(piece), owners))
    automaton.make_automaton()
    return patterns, automaton


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


def spans_in(text: str, patterns: list, automaton) -> list[tuple[int, int, int, int]]:
    """Notice, start, end and edits of the matches in a text of words joined by a space.
    Places of one notice that overlap give their best match; places without edits, all."""
    near: dict[int, set[int]] = {}
    for end, (length, owners) in automaton.iter(text):
        for k, offset in owners:
            near.setdefault(k, set()).add(end + 1 - length - offset)
    found = []
    for k, anchors in sorted(near.items()):
        p, expression = patterns[k]
        size, done = len(p.plain), -1
        exact = []
        for at in sorted(anchors):
            stop = at + size
            if at >= 0 and text.startswith(p.plain, at) and (at == 0 or text[at - 1] == " ") and (stop == len(text) or text[stop] == " "):
                exact.append((k, at, stop, 0))
        found += exact
        if not p.edits:
            continue
        taken = [a for _, a, _, _ in exact]
        for at in sorted(anchors):
            after = bisect_right(taken, at - size)  # the first exact place that ends behind this one's start
            if at + p.edits < done or (after < len(taken) and taken[after] < at + size):
                continue
            m = expression.search(text, max(0, at - p.edits - 1), min(len(text), at + size + p.edits + 1))
            if m and sum(m.fuzzy_counts) <= p.edits and (m.start() == 0 or text[m.start() - 1] == " ") and (m.end() == len(text) or text[m.end()] == " "):
                found.append((k, m.start(), m.end(), sum(m.fuzzy_counts)))
                done = m.end()
    return found


def scan(docs: DataFrame, keep: list[str], text: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """``keep``, n_words and ``spans``: an array of (label, notice, base, first_word, n_words,
    edits, similarity, matched) by place, then notice. One row for each input row, repeated ones
    too, in one pass without a shuffle; null and empty texts have no words and no spans. A text
    is read whole, in time in proportion to its length and its places."""
    span = pa.struct([pa.field("label", pa.string()), pa.field("notice", pa.string()), pa.field("base", pa.bool_()), pa.field("first_word", pa.int64()), pa.field("n_words", pa.int64()), pa.field("edits", pa.int32()), pa.field("similarity", pa.float64()), pa.field("matched", pa.string())])

    def start() -> Callable[[bytes], tuple]:
        patterns, automaton = compiled(notices)

        def of(raw: bytes) -> tuple:
            words = words_of(raw)
            text = b" ".join(words).decode("utf-8", "replace")
            spans, seen = [], (0, 0)
            for k, a, b, edits in sorted(spans_in(text, patterns, automaton), key=lambda s: (s[1], s[0])):
                p = patterns[k][0]
                seen = (a, seen[1] + text.count(" ", seen[0], a))
                spans.append((p.notice.label, p.plain, p.notice.base, seen[1], text.count(" ", a, b) + 1, edits, 1 - edits / len(p.plain), text[a:b]))
            return len(words), [dict(zip((f.name for f in span), s, strict=True)) for s in spans]

        return of

    return map_texts(docs, keep, [pa.field("n_words", pa.int64()), pa.field("spans", pa.list_(span))], start, text)


def digest(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """Counts and labels of each row's spans. Base places are those of base notices without
    edits; score is the best similarity of any span, else 0. Rows without spans have no places,
    empty labels and score 0."""
    base = F.filter("spans", lambda s: s["base"] & (s["edits"] == 0))
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    first = F.transform(base, lambda s: s["first_word"])
    return scanned.select(
        *keep,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0)).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )
