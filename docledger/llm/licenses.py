"""License scan by conditional compression.

A candidate block is compressed with each license template as a raw zstandard dictionary. The template
that shrinks it most against the plain compression is the winner; the words in which block and winner
differ confirm it, or do not. Blocks are the places that hold all telling words of a template, across line
ends and in lines of any length; then the lines with a root in what these leave.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import bytes_of, free_name, ship

LEVEL = 3
#: Words of a block that share the template's wording, and of the template that must be there.
SAME_WORDS = 0.6
LONGEST_BLOCK = 400
#: Blocks whose judgement a scanner remembers.
REMEMBERED = 4096

# Short notices of public licenses, in their usual wording.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved."),
}
#: A text is searched if it holds one of these roots: every template has one, so no text that could be
#: confirmed lacks them all. Line ends and comment signs may stand between two words of a root.
ROOTS = re.compile(
    r"licen[sc]|redistribut|permission|public\W{1,20}domain|rights\W{1,20}reserved|creative\W{1,20}commons|waived|CC\W{1,20}BY|CC0", re.I
)
WORD = re.compile(r"[A-Za-z]+|\d+(?:\.\d+)*")


# Words a notice may lack and still be the same notice.
FILLERS = set("a an the this work is are released licensed under terms of to copyright version".split())
# Words that make another license of a notice that lacks them.
OTHERS = set("affero lesser library nc nd noncommercial noderivatives noderivs sa sharealike".split())
# Words that two notices may share ("the MIT License or the Apache License").
SHARED = FILLERS | {"license", "licenses"}


class Scanner:
    """Compressors with each template as their dictionary."""

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.known = []
        for name, texts in templates.items():
            for text in texts:
                raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words = [w.lower() for w in WORD.findall(text)]
                self.known.append((name, text, words, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False)))
        self.longest = max((len(text) for _, text, _, _ in self.known), default=0)
        self.judged: dict[str, tuple] = {}

    def saved(self, block: str, compressor: zstandard.ZstdCompressor) -> int:
        raw = block.encode("utf-8", "replace")
        return len(self.plain.compress(raw)) - len(compressor.compress(raw))

    def ranked(self, block: str) -> list[tuple[int, str, list[str], zstandard.ZstdCompressor]]:
        """(bytes saved, license, template words, compressor), most bytes first."""
        raw = block.encode("utf-8", "replace")
        plain = len(self.plain.compress(raw))
        saved = [(plain - len(c.compress(raw)), name, words, c) for name, _, words, c in self.known]
        return sorted(saved, key=lambda x: -x[0])

    def judge(self, block: str) -> dict | None:
        """The winner with its differences; ties in bytes go to the template with fewer differences."""
        return self.winner(block)[0]

    def winner(self, block: str) -> tuple[dict | None, list[int], zstandard.ZstdCompressor | None]:
        """The winner, the words of the block that it matches, and its compressor."""
        if block in self.judged:
            return self.judged[block]
        ranked = self.ranked(block)
        own = [w.lower() for w in WORD.findall(block)]
        best = None
        # Equal or nearly equal reductions: versions differ by a byte or two. The wording decides.
        for saved, name, words, compressor in ranked:
            if saved <= 0 or saved < ranked[0][0] - 4:
                break
            match = difflib.SequenceMatcher(None, words, own, autojunk=False)
            matched = [m.b + i for m in match.get_matching_blocks() for i in range(m.size)]
            same = len(matched)
            lacking, added = [], []
            for kind, a, b, c, d in match.get_opcodes():
                if kind != "equal":
                    lacking += words[a:b]
                    added += own[c:d]
            key = (same / len(words), -len(added), saved)
            if best is None or key > best[0]:
                numbers = any(w[0].isdigit() for w in lacking)
                sure = same >= SAME_WORDS * len(words) and not numbers and not any(w not in FILLERS for w in lacking)
                inner = own[matched[0] : matched[-1]] if matched else []
                sure = sure and not (OTHERS & set(inner)) - set(words)
                found = {"license": name, "saved": saved, "lacking": lacking, "added": added, "confirmed": sure}
                best = (key, (found, matched, compressor))
        done = best[1] if best else (None, [], None)
        if len(self.judged) < REMEMBERED:
            self.judged[block] = done
        return done

    def spots(self, own: list[str], taken: set[int]) -> Iterator[tuple[int, int]]:
        """(first, last) word of each place that holds all telling words of a template in their order.

        Each place of the template's rarest word is tried, with as many words on both sides as the template
        has there and half as many again.
        """
        places: dict[str, list[int]] = {}
        for i, word in enumerate(own):
            if i not in taken:
                places.setdefault(word, []).append(i)
        seen = set()
        for _, _, words, _ in self.known:
            telling = {w for w in words if w not in FILLERS} or set(words)
            if not telling or not all(w in places for w in telling):
                continue
            anchor = min(telling, key=lambda w: (len(places[w]) * words.count(w), w))
            slack = len(words) // 2 + 8
            for at in (i for i, w in enumerate(words) if w == anchor):
                for place in places[anchor]:
                    low, high = max(0, place - at - slack), min(len(own), place + len(words) - at + slack)
                    if any((n := bisect_left(places[w], low)) == len(places[w]) or places[w][n] >= high for w in telling):
                        continue
                    span = self._around(words, at, own, place, low, high, telling, taken)
                    if span and span not in seen:
                        seen.add(span)
                        yield span

    @staticmethod
    def _around(words, at, own, place, low, high, telling, taken) -> tuple[int, int] | None:
        """The span of the matched words about `place`, the nearest first; None if a telling word lacks."""
        sides = []
        # The left side is read backwards, so that of equal words the nearest to the place match.
        for known, at_hand, sign in ((words[:at][::-1], range(place - 1, low - 1, -1), -1), (words[at + 1 :], range(place + 1, high), 1)):
            here = [None if i in taken else own[i] for i in at_hand]
            match = difflib.SequenceMatcher(None, known, here, autojunk=False)
            blocks = [m for m in match.get_matching_blocks() if m.size]
            found = {m.a + i for m in blocks for i in range(m.size)}
            if any(w in telling and i not in found for i, w in enumerate(known)):
                return None
            # Lone fillers far from the rest are not part of the notice.
            core = max((m.b + i for m in blocks for i in range(m.size) if here[m.b + i] in telling), default=-1)
            end = core
            for m in blocks:
                if m.b + m.size - 1 > end and m.b - end <= 4:
                    end = m.b + m.size - 1
            sides.append(place + sign * (end + 1))
        return sides[0], sides[1]

    def notices(self, text: str) -> list[dict]:
        """Confirmed notices, wherever their lines end; each word belongs to one of them, SHARED ones aside."""
        words = list(WORD.finditer(text))
        own = [w[0].lower() for w in words]
        taken: set[int] = set()
        out: list[dict] = []
        while True:
            sure = []
            for first, last in self.spots(own, taken):
                begin, end = words[first].start(), words[last].end()
                found, matched, compressor = self.winner(text[begin:end])
                if found and found["confirmed"]:
                    used = {first + i for i in matched if own[first + i] not in SHARED} or {first + i for i in matched}
                    sure.append((-found["saved"], len(found["added"]), begin, end, used, found, compressor))
            sure.sort(key=lambda x: x[:4])
            more = False
            for _, _, begin, end, used, found, compressor in sure:
                if not used & taken:
                    taken |= used
                    more = True
                    out.append({"begin": begin, "end": end, "compressor": compressor, **found})
            if not more:
                return sorted(out, key=lambda x: (x["begin"], x["end"]))

    def findings(self, text: str) -> list[dict]:
        """Confirmed notices, and the candidates in what they leave of the text, in text order."""
        if not ROOTS.search(text):
            return []
        found = self.notices(text)
        out, left = [], text
        for i, x in enumerate(found):
            begin, end = text.rfind("\n", 0, x["begin"]) + 1, text.find("\n", x["end"])
            end = len(text) if end < 0 else end
            alone = all(y["end"] <= begin or y["begin"] >= end for y in (*found[max(0, i - 1) : i], *found[i + 1 : i + 2]))
            if not alone or any(len(line) > 2 * LONGEST_BLOCK for line in text[begin:end].split("\n")):
                begin, end = x["begin"], x["end"]
            block = text[begin:end]
            around = [w.lower() for w in (*WORD.findall(text[begin : x["begin"]]), *x["added"], *WORD.findall(text[x["end"] : end]))]
            saved = self.saved(block, x["compressor"])
            out.append({"start": begin, "block": block, "license": x["license"], "saved": saved, "lacking": x["lacking"], "added": around, "confirmed": True})
        if found:
            parts, place = [], 0
            for x in found:
                if x["end"] > place:
                    parts += [text[place : max(place, x["begin"])], re.sub(r"[^\n]", " ", text[max(place, x["begin"]) : x["end"]])]
                    place = x["end"]
            left = "".join([*parts, text[place:]])
        for start, block in blocks(left, self.longest):
            best = self.judge(block)
            if best:
                out.append({"start": start, "block": text[start : start + len(block)], **best})
        return sorted(out, key=lambda x: x["start"])


def blocks(text: str, around: int = LONGEST_BLOCK) -> Iterator[tuple[int, str]]:
    """(start, block): lines that hold a root, with the lines that follow as long as these do, too.

    Long lines are cut; a piece that holds a root has `around` characters more on both sides.
    """
    place = 0
    held: list[str] = []
    begin = 0
    for line in text.split("\n"):
        if len(line) <= 2 * LONGEST_BLOCK and ROOTS.search(line):
            if not held:
                begin = place
            held.append(line)
        else:
            if held:
                yield begin, "\n".join(held)
                held = []
            if len(line) > 2 * LONGEST_BLOCK:
                for piece in sorted({m.start() // LONGEST_BLOCK for m in ROOTS.finditer(line)}):
                    start = max(0, piece * LONGEST_BLOCK - around)
                    yield place + start, line[start : (piece + 1) * LONGEST_BLOCK + around]
        place += len(line) + 1
    if held:
        yield begin, "\n".join(held)


def scan(docs: DataFrame, text: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Every row and column of `docs` with `licenses`, an array of findings, in text order.

    A finding has start (code points before the block), block, license, saved (bytes), lacking and added
    (words of the template that the block lacks, and the reverse) and confirmed: only filler words are
    lacking, and no number, and no word of another license is added. Each notice has a finding of its own, also
    where several stand in one line or in neighbouring lines; its block is its lines, or the notice alone
    where the lines are long or hold another one. A null or empty text, and one without candidate blocks,
    has an empty array. Rows are scanned one by one; a column named `licenses` is replaced.
    """
    ship(docs.sparkSession)
    known = templates or TEMPLATES
    found = free_name(docs, "found")
    finding = "array<struct<start: int, block: string, license: string, saved: int, lacking: array<string>, added: array<string>, confirmed: boolean>>"

    @F.pandas_udf(finding)
    def run(bodies: pd.Series) -> pd.Series:
        scanner, out = Scanner(known), []
        for body in bodies:
            out.append(scanner.findings(body.decode("utf-8", "replace")))
        return pd.Series(out, dtype=object)

    return docs.withColumn(found, run(bytes_of(text))).drop("licenses").withColumnRenamed(found, "licenses")
