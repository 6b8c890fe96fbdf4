"""License scans: ordered signature rules behind a keyword prefilter.

A rule is a regular expression over lower-cased words joined by single spaces, with a label, a priority and a confidence (see
``license_rules``). It names its gate words, one of which every match holds: mostly rare words of its own. The gate words of a text are
found in one pass of an Aho-Corasick automaton, and only windows of words around them are matched, by the rules they open.

Detections overlap: "gnu lesser general public license version 2.1" holds "general public license". A detection whose words
lie within those of one of higher priority, or of the same priority and more words, is dropped. Base phrases (``BASE``) are places, not
detections: none is ever dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import WORD, blocks
from .license_rules import FAMILIES, FORMS, SIGNATURES
from .tables import map_arrow

#: Phrase -> label of the base phrases (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The word that every base phrase ends with.
BASE_WORD = "license"
#: Words on each side of a gate word in which its rules are matched; no match spans more.
REACH = 28


@dataclass(frozen=True)
class Rule:
    label: str
    name: str
    pattern: re.Pattern
    priority: int
    confidence: float
    gates: tuple[str, ...]


def ruled(label: str, name: str, pattern: str, priority: int, confidence: float, gates: str) -> Rule:
    return Rule(label, name, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), priority, confidence, tuple(gates.split()))


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, in their order: highest priority first, then as listed."""
    out = []
    for label, gates, name, versions, spdx in FAMILIES:
        for form, pattern, priority, confidence in FORMS:
            if versions or form != "version":
                out.append(ruled(label, f"{label}_{form}", pattern.format(n=name, v=versions or "0", s=spdx), priority, confidence, gates))
    for k, line in enumerate(SIGNATURES.strip().splitlines()):
        label, priority, confidence, gates, pattern = line.split(" | ")
        out.append(ruled(label, f"{label}_signature_{k}", pattern, int(priority), float(confidence), gates))
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def opened() -> dict[tuple[str, ...], tuple[Rule, ...]]:
    """Rules by their gate words."""
    return {g: tuple(r for r in rules() if r.gates == g) for g in dict.fromkeys(r.gates for r in rules())}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for keyword in {BASE_WORD, *(w for r in rules() for w in r.gates)}:
        found.add_word(keyword, keyword)
    found.make_automaton()
    return found


@dataclass(frozen=True)
class Detection:
    first: int
    last: int  # the word after its last one
    rule: Rule


def base_places(words: list[str], at: list[int]) -> list[tuple[int, str]]:
    """(word, label) of every base phrase that begins at most two words before one of the given words."""
    out = set()
    for k in at:
        for phrase, label in BASE.items():
            parts = phrase.split()
            start = k - len(parts) + 1
            if start >= 0 and words[start : k + 1] == parts:
                out.add((start, label))
    return sorted(out)


def detect(words: list[str], places: dict[str, list[int]]) -> list[Detection]:
    """All detections around the gate words, each once; places are those of whole words."""
    found = {}
    for gates, own in opened().items():
        merged: list[list[int]] = []
        for k in sorted({k for g in gates for k in places.get(g, ())}):
            low, high = max(0, k - REACH), min(len(words), k + REACH + 1)
            if merged and low <= merged[-1][1]:
                merged[-1][1] = high
            else:
                merged.append([low, high])
        for low, high in merged:
            window = " ".join(words[low:high])
            begins = [0]
            for w in words[low:high]:
                begins.append(begins[-1] + len(w) + 1)
            for rule in own:
                for m in rule.pattern.finditer(window):
                    first = low + bisect_right(begins, m.start()) - 1
                    last = low + bisect_left(begins, m.end())
                    found[first, last, rule.name] = Detection(first, last, rule)
    return sorted(found.values(), key=lambda d: (-d.rule.priority, d.first - d.last, d.first, d.rule.name))


def suppressed(detections: list[Detection]) -> list[Detection]:
    """Those that aren't contained in one that comes before them in order of priority, then words."""
    kept: list[Detection] = []
    begins = sorted({d.first for d in detections})
    reach = [0] * (len(begins) + 1)  # a Fenwick tree: the farthest end of what is kept, by begin
    for d in detections:
        place = bisect_right(begins, d.first)
        k, farthest = place, 0
        while k:
            farthest, k = max(farthest, reach[k]), k & (k - 1)
        if farthest < d.last:
            kept.append(d)
            k = place
            while k <= len(begins):
                reach[k], k = max(reach[k], d.last), k + (k & -k)
    return sorted(kept, key=lambda d: (d.first, d.last, d.rule.name))


SCHEMA = "id bigint, n_words bigint, places array<struct<word:bigint,label:string>>, detections array<struct<first:bigint,last:bigint,label:string,rule:string,confidence:double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = automaton()
    place_kind = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found_kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("confidence", pa.float64())]))
    for batch in batches:
        for block in blocks(batch.column(1)):
            block.find_words()
            data = block.data.tobytes()
            all_places, all_found = [], []
            for d in range(block.last - block.first):
                low, high = int(block.offsets[d]), int(block.offsets[d + 1])
                text = data[low:high].decode("latin-1")  # a character for each byte, so places are bytes
                hits = [
                    (low + end, keyword)
                    for end, keyword in find.iter(text)
                    if not (end + 1 < len(text) and WORD[ord(text[end + 1])]) and not (end >= len(keyword) and WORD[ord(text[end - len(keyword)])])
                ]
                places, found = [], []
                if hits:
                    a, b = block.word_at[d], block.word_at[d + 1]
                    starts, ends = block.starts[a:b], block.ends[a:b]
                    at = np.searchsorted(starts, [end for end, _ in hits], side="right") - 1
                    words = _Words(data, starts, ends)
                    by_keyword: dict[str, list[int]] = {}
                    for k, (_, keyword) in zip(at.tolist(), hits, strict=True):
                        by_keyword.setdefault(keyword, []).append(k)
                    places = [{"word": w, "label": label} for w, label in base_places(words, by_keyword.get(BASE_WORD, []))]
                    found = [
                        {"first": x.first, "last": x.last, "label": x.rule.label, "rule": x.rule.name, "confidence": x.rule.confidence}
                        for x in suppressed(detect(words, by_keyword))
                    ]
                all_places.append(places)
                all_found.append(found)
            n = block.last - block.first
            counts = pa.array(np.diff(block.word_at).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, n), counts, pa.array(all_places, place_kind), pa.array(all_found, found_kind)], ["id", "n_words", "places", "detections"])


class _Words:
    """The words of one document, decoded as they are asked for."""

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, part: slice) -> list[str]:
        return [self.data[a:b].decode() for a, b in zip(self.starts[part].tolist(), self.ends[part].tolist(), strict=True)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, places (base phrases), detections (after suppression).

    Null texts are empty and have neither; null ids and repeated rows each have their row; further columns are ignored.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_arrow(texts, _scan, SCHEMA)
