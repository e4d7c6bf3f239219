"""License scans by template-markup matching.

A template is text with two kinds of markup: [[...]] is optional wording, {{n}} stands for one to n words of any
kind (a name, a year). Compiled, it is an automaton over words: states between mandatory words, optional regions as
branches and replaceable ones as bounded loops. A text carries the license if the automaton accepts a run of its
words: mandatory wording exactly, optional wording whole or not at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import words

#: The base phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates of the common notices, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license [[, ]] version 2 [[.]] 0 [[the license]]",
    "mit": "[[released|licensed]] under the mit license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-4.0": "licensed under [[a]] [[the]] [[creative commons attribution]] cc by [[-]] 4 0 [[international]] [[license]]",
    "cc-by-nc-4.0": "licensed under [[a]] [[the]] cc by nc 4 0 [[international]] [[license]]",
    "cc-by-sa-4.0": "licensed under [[a]] [[the]] cc by sa 4 0 [[international]] [[license]]",
    "gpl-2.0": "gnu general public license [[as published by the free software foundation either]] version 2 [[of the license]]",
    "gpl-3.0": "gnu general public license [[as published by the free software foundation either]] version 3 [[of the license]]",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "copyright": "copyright [[c]] {{6}} all rights reserved",
    "mpl-2.0": "subject to the terms of the mozilla public license v [[.]] 2 0",
    "public-domain": "[[this is]] free and unencumbered software released into the public domain",
}


@dataclass
class Automaton:
    """Edges by state: (word or None for any word, next state), free moves by state, and the accepting state."""

    edges: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    start: int = 0
    accept: int = 0
    needs: frozenset[bytes] = frozenset()
    length: int = 0

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1


def compiled(template: str) -> Automaton:
    """The automaton of a template; wording is taken word by word as texts are."""
    a, at, needs = Automaton(), 0, []

    def run(start: int, text: str) -> int:
        for w in words(text.encode()):
            end = a.state()
            a.edges[start].append((w, end))
            start = end
        return start

    for token in re.split(r"(\[\[.*?\]\]|\{\{\d+\}\})", template):
        if token.startswith("[["):
            end = a.state()
            for choice in token[2:-2].split("|"):
                a.free[run(at, choice)].append(end)
            a.free[at].append(end)
            at = end
        elif token.startswith("{{"):
            end = a.state()
            for _ in range(int(token[2:-2])):
                step = a.state()
                a.edges[at].append((None, step))
                a.free[step].append(end)
                at = step
            at = end
        else:
            needs += words(token.encode())
            at = run(at, token)
    a.accept, a.needs, a.length = at, frozenset(needs), len(needs)
    return a


def closure(a: Automaton, states: set[int]) -> set[int]:
    todo, seen = list(states), set(states)
    while todo:
        for s in a.free[todo.pop()]:
            if s not in seen:
                seen.add(s)
                todo.append(s)
    return seen


def accepted(a: Automaton, tokens: list[bytes], at: int) -> int | None:
    """Where the longest run of words from `at` on that the automaton accepts ends, or None."""
    states, end = closure(a, {a.start}), None
    while states:
        if a.accept in states:
            end = at
        if at == len(tokens):
            break
        w = tokens[at]
        states = closure(a, {t for s in states for label, t in a.edges[s] if label is None or label == w})
        at += 1
    return end


class Scanner:
    """Base places and template matches of texts; one per Python worker."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [([w.encode() for w in p.split()], label) for p, label in phrases.items()]
        self.automata = {label: compiled(t) for label, t in templates.items()}
        # The words that a run can start with, for each automaton.
        self.heads = {
            label: frozenset(w for s in closure(a, {a.start}) for w, _ in a.edges[s]) for label, a in self.automata.items()
        }

    def __call__(self, text: bytes | None) -> dict:
        tokens = words(text)
        places, matches, seen = [], [], None
        raw = text.lower() if text else b""
        for phrase, label in self.phrases:
            if all(w in raw for w in phrase):
                at = -1
                while True:
                    try:
                        at = tokens.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if tokens[at:at + len(phrase)] == phrase:
                        places.append((at, label))
        for label, a in self.automata.items():
            if not all(w in raw for w in a.needs):
                continue
            seen = seen if seen is not None else self.positions(tokens)
            if not a.needs <= seen.keys():
                continue
            starts = range(len(tokens)) if None in self.heads[label] else sorted(p for h in self.heads[label] for p in seen.get(h, ()))
            done = 0
            for at in starts:
                if at >= done and (end := accepted(a, tokens, at)) is not None and end > at:
                    matches.append((label, at, end))
                    done = end
        return {"n_words": len(tokens), "places": sorted(places), "matches": sorted(matches, key=lambda m: (m[1], m[0]))}

    @staticmethod
    def positions(tokens: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for at, w in enumerate(tokens):
            out.setdefault(w, []).append(at)
        return out


def scanned(text: str | Column, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> Column:
    """struct<n_words, places, matches> of a text: base places (word, label), template matches (label, start, end in
    words, end exclusive). A NULL text is empty."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    match = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    @F.arrow_udf("struct<n_words:bigint,places:array<struct<word:bigint,label:string>>,matches:array<struct<label:string,start:bigint,end:bigint>>>")
    def scan(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(phrases, templates)
        for texts in parts:
            rows = [scanner(t.cast(pa.binary()).as_py()) for t in texts]
            yield pa.StructArray.from_arrays([
                pa.array([r["n_words"] for r in rows], pa.int64()),
                pa.array([[dict(zip(("word", "label"), p)) for p in r["places"]] for r in rows], pa.list_(place)),
                pa.array([[dict(zip(("label", "start", "end"), m)) for m in r["matches"]] for r in rows], pa.list_(match)),
            ], ["n_words", "places", "matches"])

    return scan(F.col(text) if isinstance(text, str) else text)


def scan_documents(docs: DataFrame) -> DataFrame:
    """A row for every row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the share of certainty that the text carries a license: a template's exact wording counts 0.9, base
    places alone 0.5, several kinds of evidence more; 0 without any. Texts without words have no label. Repeated rows
    and NULL ids are answered each; other columns are left out."""
    s = docs.select("doc_id", scanned("text").alias("s"))
    base = F.array_sort(F.array_distinct(F.transform("s.places", lambda p: p["label"])))
    more = F.array_distinct(F.transform("s.matches", lambda m: m["label"]))
    every = F.array_sort(F.array_union(base, more))
    n = F.size("s.places").cast("bigint")
    first = F.when(n > 0, F.array_min(F.transform("s.places", lambda p: p["word"])))
    last = F.when(n > 0, F.array_max(F.transform("s.places", lambda p: p["word"])))
    score = 1 - F.pow(F.lit(0.1), F.size(more)) * F.pow(F.lit(0.5), F.size(base))
    return s.select(
        "doc_id", F.col("s.n_words").alias("n_words"), n.alias("n_base"), first.alias("first_word"), last.alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"),
    )
