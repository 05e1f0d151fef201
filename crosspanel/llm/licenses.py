"""License scan: templates with optional and replaceable regions, compiled into token automata."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import lower_ascii_text, map_records, query, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases of the base scan and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licenses and their usual notices. Words in [[ ]] may be left out;
# {{n}} stands for zero to n words of any kind.
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license [[,]] version 2 0 [[the license you may not use this file except in compliance with the license]]",
    "gpl-3.0-notice": "licensed under the gnu general public license [[,]] [[as published by the free software foundation]] version 3 [[or {{2}} any later version]]",
    "gpl-any-notice": "redistribute it and or modify it under the terms of the gnu general public license [[as published by the free software foundation]] [[either]] version {{3}} any later version",
    "cc-by-notice": "licensed under [[a]] [[the]] [[creative commons]] cc by {{1}} 4 0",
    "mit-notice": "released under the [[terms of the]] mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the {{2}} to deal in the {{2}} without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the {{2}} and to permit persons to whom the {{2}} is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the {{2}}",
    "isc-text": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
}

# score of a text: a whole template found, only a phrase, neither
TEMPLATE_SCORE, PHRASE_SCORE = 1.0, 0.5


class Automaton:
    """States 0..n over words. `step[s]` has the word to read and the next state; `skip[s]` the states
    reached without reading; a replaceable region of n words is n states that read any word."""

    def __init__(self, template: str) -> None:
        self.step: list[tuple[str | None, int]] = []
        self.skip: dict[int, list[int]] = defaultdict(list)
        opened: list[int] = []
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
            at = len(self.step)
            if part == "[[":
                opened.append(at)
            elif part == "]]":
                if opened[-1] != at:
                    self.skip[opened[-1]].append(at)
                opened.pop()
            elif part.startswith("{{"):
                n = int(part[2:-2])
                for k in range(n):
                    self.skip[at + k].append(at + n)
                    self.step.append((None, at + k + 1))
            else:
                self.step += [(w, at + k + 1) for k, w in enumerate(WORD.findall(part))]
        self.end = len(self.step)
        self.first = {self.step[s][0] for s in self.closed({0}) if s < self.end}
        if None in self.first:
            raise ValueError("a template starts with a word of its own")

    def closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def match(self, words: list[str], start: int) -> int:
        """End of the longest match that starts at `start`, or -1."""
        states, best = self.closed({0}), -1
        for at in range(start, len(words) + 1):
            if self.end in states:
                best = at
            if at == len(words):
                break
            word = words[at]
            states = self.closed({t for s in states if s < self.end for w, t in (self.step[s],) if w is None or w == word})
            if not states:
                break
        return best


@lru_cache(maxsize=4)
def automata(templates: tuple[tuple[str, str], ...]) -> dict[str, list[tuple[str, Automaton]]]:
    """By the word a match starts with."""
    by_word: dict[str, list[tuple[str, Automaton]]] = defaultdict(list)
    for label, template in templates:
        a = Automaton(template)
        for w in a.first:
            by_word[w].append((label, a))
    return dict(by_word)


def scan(text: str | None, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Number of words, phrase matches and template matches (label, first word, end), all places."""
    words = WORD.findall(lower_ascii_text(text)) if text else []
    if not words:
        return 0, [], []
    present = set(words)
    base, whole = [], []
    wanted = defaultdict(list)
    for phrase, label in phrases.items():
        parts = phrase.split()
        if present.issuperset(parts):
            wanted[parts[0]].append((parts, label))
    starts = {w: v for w, v in automata(tuple(templates.items())).items() if w in present}
    if wanted or starts:
        for at, word in enumerate(words):
            for parts, label in wanted.get(word, ()):
                if words[at : at + len(parts)] == parts:
                    base.append((label, at, at + len(parts)))
            for label, automaton in starts.get(word, ()):
                if (end := automaton.match(words, at)) > 0:
                    whole.append((label, at, end))
    return len(words), base, whole


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, n_words, phrases and templates, each array<struct<label, start, end>>.

    A null or empty text has no words and no matches; repeated rows give
    repeated results, an empty table an empty one; other columns are not read.
    Work per word is bounded by the templates, so texts of any length are read
    whole. One pass, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    place = "array<struct<label:string,start:bigint,end:bigint>>"

    def run(rows):
        for key, text in rows:
            n, base, whole = scan(text)
            yield (key, n, *[[dict(zip(("label", "start", "end"), m)) for m in found] for found in (base, whole)])

    return map_records(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_words bigint, phrases {place}, templates {place}")


def license_digest(docs: DataFrame) -> DataFrame:
    label, start = (lambda m: m["label"]), (lambda m: m["start"])
    distinct = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("bigint").alias("n_base"),
        F.array_min(F.transform("phrases", start)).alias("first_word"),
        F.array_max(F.transform("phrases", start)).alias("last_word"),
        distinct(F.transform("phrases", label)).alias("base_labels"),
        distinct(F.concat(F.transform("phrases", label), F.transform("templates", label))).alias("labels"),
        F.when(F.size("templates") > 0, TEMPLATE_SCORE).when(F.size("phrases") > 0, PHRASE_SCORE).otherwise(0.0).alias("score"),
    )


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template texts in every document."""
    return license_digest(table(spark, sf_dir, "documents"))
