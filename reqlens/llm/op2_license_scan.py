"""License scan by conditional compression (operator 2).

Candidate blocks are the lines of a text that use license vocabulary, runs of
such lines taken together.  A block is compressed alone and with each template
as zstandard raw dictionary; templates are ranked by how many bytes they save.
The best ``RANKED`` and all others that save bytes are then compared word by
word: a word edit weighs ``1 / MAX_EDIT_SHARE`` words of the template, and the
template with most words left wins, so of licenses that share a text the one
whose further clauses are there too.  It is confirmed if nothing is below zero
and no edit touches the words that tell licenses apart (names and
version numbers).  The differing words are reported.  A confirmed part is taken
out and the rest judged again, so a block may give several rows.  A block is
judged line by line first, so a long list of notices takes linear time; lines
that confirm nothing alone are judged together, then with ``AROUND`` characters
on both sides, which hold the whole of any template: a wrapped license text is
found from any of its cues and reported once.  Templates hold grants and
conditions; disclaimers do not tell licenses apart.

Defined cases: null, empty and cue-free texts give no row; a block without a
confirmed template is reported with a null license; repeated rows are reported
each; very long lines are judged in windows around their cues; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.llm.common import read_table
from reqlens.llm.op1_decontamination import nearest

# fixed values: parts of license texts
_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
          "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
          "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
          "to permit persons to whom the Software is furnished to do so")
_NOTICE = (", subject to the following conditions: The above copyright notice and this permission notice shall be included "
           "in all copies or substantial portions of the Software.")
_REDISTRIBUTION = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                   "that the following conditions are met")
_CONDITIONS = (": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
               "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list "
               "of conditions and the following disclaimer in the documentation and/or other materials provided with the "
               "distribution.")
_ENDORSEMENT = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                "promote products derived from this software without specific prior written permission.")
_PERMISSION = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
               "hereby granted")
_APPEAR = ", provided that the above copyright notice and this permission notice appear in all copies."
#: fixed values: (license, words that tell it apart, notice)
NOTICES = (
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT license."),
    ("MIT", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    *((name, "", _GRANT + more) for name, more in (
        ("MIT-0", ""), ("MIT", _NOTICE),
        ("JSON", _NOTICE + " The Software shall be used for Good, not Evil."),
        ("X11", _NOTICE + " Except as contained in this notice, the name of the X Consortium shall not be used in advertising "
                          "or otherwise to promote the sale, use or other dealings in this Software without prior written "
                          "authorization from the X Consortium."))),
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
                               "file except in compliance with the License."),
    ("GPL-2.0", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "gnu general 3", "This program is free software: you can redistribute it and/or modify it under the terms "
                                 "of the GNU General Public License as published by the Free Software Foundation, either "
                                 "version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "lesser 2 1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "bsd 2", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "bsd 3", "Licensed under the BSD 3-Clause License."),
    ("BSD", "", _REDISTRIBUTION),
    ("BSD-2-Clause", "", _REDISTRIBUTION + _CONDITIONS),
    ("BSD-3-Clause", "", _REDISTRIBUTION + _CONDITIONS + _ENDORSEMENT),
    ("0BSD", "", _PERMISSION), ("ISC", "", _PERMISSION + _APPEAR),
    ("ISC", "isc", "Licensed under the ISC License."),
    ("MPL-2.0", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "eclipse 2", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("CC0-1.0", "cc0", "Released under CC0 1.0 Universal."),
    ("CC-BY-4.0", "cc by 4", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc by sa 4", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "cc by nc 4", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "cc by nd 4", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "cc by nc sa 4", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "attribution 4", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "attribution sharealike 4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                                                 "International License."),
    ("Unlicense", "unencumbered", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "reserved", "All rights reserved."),
)
#: words of license names that tell none apart
_COMMON = {"0", "clause", "cc"}
#: the notices and an SPDX tag of every license
TEMPLATES = NOTICES + tuple(
    (name, " ".join(w for w in re.findall(r"[^\W_]+", name.lower()) if w not in _COMMON), f"SPDX-License-Identifier: {name}")
    for name in dict.fromkeys(name for name, _, _ in NOTICES if name not in ("BSD", "proprietary")))
#: fixed values: license vocabulary
CUE = re.compile(r"licen[cs]e|copyright|warrant|redistribut|permission (?:is|to use)|all rights reserved|public domain|spdx-|\bcc[ -]by\b|\bcc0\b", re.I | re.A)
#: fixed values: a text without any of these, in lower case, has no cue
HINTS = ("licen", "copyright", "warrant", "redistribut", "permission is", "permission to use", "all rights reserved", "public domain", "spdx-",
         "cc by", "cc-by", "cc0")
RANKED = 4
MAX_EDIT_SHARE = 0.2
#: a longer line is judged in windows of WINDOW characters on both sides of its cues, before it is widened
LONG_LINE, WINDOW = 2000, 400
#: what a block is widened by: more than any template with its line breaks and comment marks
AROUND = 2 * max(len(text) for _, _, text in TEMPLATES)
LEVEL = 3
_WORD = re.compile(r"[^\W_]+")


@cache
def _compressors() -> tuple:
    out = []
    for _, _, text in TEMPLATES:
        d = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))
    return tuple(out), zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def blocks(text: str) -> list[tuple[int, int]]:
    """Candidate blocks as code-point ranges, merged where they touch."""
    out: list[list[int]] = []
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    first = last = -1                       # the cue's line
    for m in CUE.finditer(text):
        if m.end() > last:
            first, last = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            last = len(text) if last < 0 else last
        a, b = first, last
        if b - a > LONG_LINE:
            a, b = max(a, m.start() - WINDOW), min(b, m.end() + WINDOW)
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def ranking(block: str) -> list[tuple[int, int]]:
    """(bytes saved, template number), best first."""
    conditional, plain = _compressors()
    raw = block.encode()
    alone = len(plain.compress(raw))
    return sorted(((alone - len(c.compress(raw)), i) for i, c in enumerate(conditional)), key=lambda x: (-x[0], x[1]))


def judge(block: str) -> tuple:
    """(license, bytes saved, share saved, edits, differences, confirmed)."""
    return _judge(block)[0]


def judge_all(block: str) -> list[tuple]:
    """:func:`judge` for every license of a block.  Without any, the block
    as a whole."""
    return [found for *_, found in _confirmed(block, 0, len(block))[0]] or [judge(block)]


def _confirmed(text: str, start: int, end: int) -> tuple[list[tuple], list[tuple[int, int]]]:
    """(start, end, finding) of every confirmed license of a block, and the
    runs of lines that hold none."""
    out, runs = [], []
    for line in re.finditer(r"[^\n]+", text[start:end]):
        a, b = start + line.start(), start + line.end()
        found = _peeled(text, a, b)
        out += found
        if not found:
            if runs and not out[runs[-1][2]:] and text[runs[-1][1]:a].isspace():
                runs[-1] = (runs[-1][0], b, runs[-1][2])
            else:
                runs.append((a, b, len(out)))
    left = []
    for a, b, _ in runs:
        found = _peeled(text, a, b) if "\n" in text[a:b] else []
        out += found
        if not found:
            left.append((a, b))
    return out, left


def _peeled(text: str, start: int, end: int) -> list[tuple]:
    """Confirmed licenses of text[start:end]: what is left on the sides of each is judged again."""
    out, todo = [], [(start, end)]
    while todo:
        a, b = todo.pop()
        found, s, e = _judge(text[a:b])
        if found[-1]:
            out.append((a + s, a + e, found))
            todo += [(x, y) for x, y in ((a, a + s), (a + e, b)) if CUE.search(text, x, y)]
    return out


def findings(text: str) -> list[tuple]:
    """(start, end, *finding) of a whole text: the block of each confirmed
    license - or, found by widening, its own place - and each block without one."""
    out, wide = [], set()
    for a, b in blocks(text):
        sure, left = _confirmed(text, a, b)
        found = [(a, b, *f) for *_, f in sure]
        met = bool(found)
        for x, y in left:
            if any(s <= x and y <= e for s, e in wide):
                met = True
                continue
            lo, hi = max(0, x - AROUND), min(len(text), y + AROUND)
            if not _possible(text[lo:hi]):
                continue
            f, s, e = _judge(text[lo:hi])
            place = (lo + s, lo + e)
            if f[-1] and place[0] < y and x < place[1]:
                met = True
                if place not in wide and not any(a2 <= place[0] and place[1] <= b2 for a2, b2, *_ in out):
                    wide.add(place)
                    found.append((*place, *f))
        out += found
        if not met and not any(s < b and a < e for s, e in wide):
            out.append((a, b, *judge(text[a:b])))
    return out


@cache
def _bags() -> tuple:
    return tuple((len(w), Counter(w)) for w in (words(text) for _, _, text in TEMPLATES))


def _possible(block: str) -> list[int]:
    """Templates with enough of their words in the block, in any order."""
    own = Counter(words(block))
    return [i for i, (n, bag) in enumerate(_bags())
            if n - sum(min(k, own[w]) for w, k in bag.items()) <= MAX_EDIT_SHARE * n]


def _judge(block: str) -> tuple[tuple, int, int]:
    """:func:`judge`, and the part of the block that was compared."""
    own, best = words(block), None
    ranks = ranking(block)
    alone = len(_compressors()[1].compress(block.encode()))
    # a template that cannot be confirmed is compared only where none can
    possible = set(_possible(block)) or {i for _, i in ranks[:RANKED]}
    for saved, i in ranks:
        if i not in possible or (saved <= 0 and best):
            continue
        name, keys, text = TEMPLATES[i]
        want = words(text)
        edits, a, b = nearest(want, own, len(want) + len(own))
        part = own[a:b]
        lost = [k for k in keys.split() if k not in part]
        foreign = [w for w in part if w in _KEYS and w not in want]
        key = (bool(lost or foreign), edits / MAX_EDIT_SHARE - len(want), -saved, i)
        if best is None or key < best[0]:
            best = (key, name, saved, edits, want, part, a, b)
    (bad, *_), name, saved, edits, want, part, start, end = best
    ok = not bad and edits <= MAX_EDIT_SHARE * len(want) and saved > 0
    diff = "; ".join(f"{' '.join(want[a:b])} -> {' '.join(part[c:d])}"
                     for op, a, b, c, d in SequenceMatcher(None, want, part, autojunk=False).get_opcodes() if op != "equal")
    place = [m.span() for m in _WORD.finditer(block)][start:end]
    return ((name if ok else None, saved, saved / max(1, alone), edits, diff, ok),
            place[0][0] if place else 0, place[-1][1] if place else len(block))


#: every word that tells some license apart
_KEYS = frozenset(k for _, keys, _ in TEMPLATES for k in keys.split())


def license_blocks(docs: DataFrame) -> DataFrame:
    """One row per confirmed license of a candidate block, or one for a block without any."""
    schema = ("doc_id long, start long, end long, license string, bytes_saved long, share_saved double, "
              "edits long, differences string, confirmed boolean")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.bool_()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(doc_id, *found) for found in findings(text or "")]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return license_blocks(read_table(spark, sf_dir, "documents"))
