"""License scans by conditional compression, confirmed by exact differences of wording.

Templates are whole license texts, notices of source files, and sheets of a license's names and statements; each is a
zstandard raw dictionary of its own. Candidate blocks follow from pairs of neighbouring words: of a notice or text within
the limits so many pairs must be left in so many words, and of a statement its rarest pair. A block is compressed alone
and with the dictionary of each template that may stand in it; those that save much of it, and much of what the best one
saves, are compared word by word, and the words that are missing and that stand between are part of the result. Words of a
confirmed statement are taken out of its block, and the rest is ranked again. Where confirmed places overlap, that one
stays whose template reduces the size of its words most.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import freeing, in_small_batches, pieces_of

#: Share of a block's compressed size that the dictionary of a notice or whole text must save.
LEAST_SHARE = 0.15
#: Share of what the best dictionary saves there that others must save, or so many bytes less than it: names of a word or two
#: save hardly more than a match costs, so of statements only the order of the savings tells anything.
OF_BEST, SLACK = {"statement": 0.5, "notice": 0.3, "text": 0.3}, 3
#: Rare pairs of statements this many words apart share a block.
CLUSTER = 24
#: A statement must be there word by word; of a notice at most this share may be missing, or stand between.
MISSING, BETWEEN = 0.1, 0.25
#: Words of an anchor: runs that a whole text holds once. Gaps between anchors above GAP_WORDS count as differences.
ANCHOR, GAP_WORDS = 4, 400
EXACT = 10_000

# Words that every license name, statement or short notice holds one of, whatever stands between two words (_) and at
# either end (<, >); the same in Java and Python. A test holds every wording of templates() against it.
KEYWORDS = r"licen[sc]|copyright|copyleft|spdx|warrant|permission|redistribut|creative_commons|public_domain|all_rights_reserved|<cc_by>|<cc0>|<[al]?gpl|<under_(?:the_terms_of_)?(?:the_)?(?:mit|mpl|bsd|apache)>|<(?:apache|mpl|epl|cddl|eupl|ofl|gfdl|odbl|bsl|artistic|python)_[0-9]"
# Words of which every notice and whole text has more than may be missing, so that some are always left.
LEGAL = "licens|copyright|warrant|permi|distribut|software|program|work|domain|unencumbered|terms|condition|rights|public|foundation|source|liab|version|modif|copies|copy|notice|free|purpose|commercial|creat|library|grant|provide|released|intellectual|endorse|promote|neither|derived|written|contribut|mozilla|obtain"
PARTS = LEGAL.split("|")
KEYWORDS = KEYWORDS.replace("<", "(?<![a-zA-Z0-9])").replace(">", "(?![a-zA-Z0-9])").replace("_", "[^a-zA-Z0-9]+")

# Parts of texts, all of a group in every text with such a keyword, and what must match then, if that isn't enough.
QUICK = [
    (["licen"], None), (["copyright"], None), (["copyleft"], None), (["spdx"], None), (["warrant"], None), (["permission"], None), (["redistribut"], None),
    (["creative", "commons"], None), (["public", "domain"], None), (["rights", "reserved"], None), (["gpl"], None), (["cc0"], None),
    (["cc", "by"], "cc[^a-z0-9]+by"), (["under", "mit"], "under[^a-z0-9]+(?:the[^a-z0-9]+)?(?:terms[^a-z0-9]+of[^a-z0-9]+)?(?:the[^a-z0-9]+)?mit"),
    (["under", "mpl"], None), (["under", "bsd"], None), (["under", "apache"], None),
    *(([x], x + "[^a-z0-9]+[0-9]") for x in ("apache", "mpl", "epl", "cddl", "eupl", "ofl", "gfdl", "odbl", "bsl", "artistic", "python")),
]

# Names of licenses as statements give them; every statement of the list below is made with each.
NAMES = {
    "MIT": ["MIT License", "the MIT License", "the MIT licence", "MIT"],
    "BSD": ["BSD License", "the BSD License", "BSD"],
    "ISC": ["ISC License", "the ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "the BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "the BSD 3-Clause License", "the New BSD License", "the Modified BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0", "Apache 2"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "the GPL v2", "the GPLv2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "the GPL v3", "the GPLv3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1", "the LGPLv2.1", "the LGPL v2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the GNU LGPL v3", "the LGPLv3", "the LGPL v3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU AGPL v3", "the AGPLv3", "the AGPL v3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"],
    "MPL-1.1": ["the Mozilla Public License, version 1.1", "the MPL 1.1"],
    "EPL-1.0": ["the Eclipse Public License, version 1.0", "the Eclipse Public License 1.0"],
    "CDDL-1.0": ["the Common Development and Distribution License, Version 1.0"],
    "EUPL-1.2": ["the European Union Public Licence v. 1.2", "the European Union Public License 1.2"],
    "Zlib": ["the zlib License", "the zlib/libpng License"],
    "0BSD": ["the Zero-Clause BSD License", "the BSD Zero Clause License"],
    "X11": ["the X11 License"],
    "NCSA": ["the University of Illinois/NCSA Open Source License"],
    "Python-2.0": ["the Python Software Foundation License", "the PSF License"],
    "PostgreSQL": ["the PostgreSQL License"],
    "Artistic-2.0": ["the Artistic License 2.0", "the Artistic License, Version 2.0"],
    "OFL-1.1": ["the SIL Open Font License, Version 1.1", "the SIL Open Font License 1.1"],
    "GFDL-1.3": ["the GNU Free Documentation License, version 1.3"],
    "ODbL-1.0": ["the Open Database License", "the Open Database License 1.0"],
    "Unlicense": ["the Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0", "the CC0 1.0 Universal Public Domain Dedication"],
}
# The Creative Commons elements, from which names and statements follow.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _short, _long in COMMONS.items():
    NAMES[f"CC-{_short}"] = [f"CC {_short}", f"CC-{_short}", f"Creative Commons {_long}", f"a Creative Commons {_long} License"]
    for _version in ("4.0", "3.0", "2.0"):
        NAMES[f"CC-{_short}-{_version}"] = [
            f"CC {_short} {_version}",
            f"CC-{_short}-{_version}",
            f"Creative Commons {_long} {_version}",
            f"a Creative Commons {_long} {_version} International License",
            f"the Creative Commons {_long} {_version} International License",
        ]
STATEMENTS = ["Licensed under {}", "Released under {}", "Distributed under {}", "Available under {}", "Published under {}", "under the terms of {}", "{} licensed", "License: {}", "Licence: {}"]

# Headings of license texts and other short forms.
HEADINGS = {
    "MIT": ["The MIT License", "MIT licensed"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004", "Apache 2.0 licensed"],
    "GPL-2.0": ["GNU General Public License Version 2, June 1991", "GPLv2 licensed"],
    "GPL-3.0": ["GNU General Public License Version 3, 29 June 2007", "GPLv3 licensed"],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "AGPL-3.0": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "BSD-2-Clause": ["BSD 2-Clause licensed"],
    "BSD-3-Clause": ["BSD 3-Clause licensed"],
}

# Opening or whole notices as their licenses word them.
NOTICES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
    "Proprietary": ["All rights reserved."],
}

# Words of notices that tell licenses apart, each run of them whole: name and version.
IDENTITY = {
    "Apache-2.0": ["Apache License", "2.0"],
    "GPL-2.0": ["GNU General Public License", "2"],
    "GPL-3.0": ["GNU General Public License", "3"],
    "LGPL-2.0": ["GNU Library General Public License", "2"],
    "LGPL-2.1": ["GNU Lesser General Public License", "2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License", "3"],
    "AGPL-3.0": ["GNU Affero General Public License", "3"],
    "MPL-2.0": ["Mozilla Public License", "2.0"],
}

ARTICLE = re.compile(r"^(?:the|a) ")
WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")


def worded(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words in lower case, and where each stands. Lower-casing keeps every place."""
    found = [(m[0], m.span()) for m in WORD.finditer("".join(c.lower() if c.isascii() else c for c in text) if not text.isascii() else text.lower())]
    return [w for w, _ in found], [s for _, s in found]


@dataclass(frozen=True)
class Template:
    license: str
    kind: str  # text, notice or statement
    wordings: tuple[tuple[str, ...], ...]  # of a statement's sheet many, else one


@lru_cache(1)
def sheets() -> list[Template]:
    """Whole texts from the files beside this module, notices, and a sheet of statements a license."""
    worded_ = lambda x: tuple(worded(x)[0])
    out = []
    for name, wordings in NAMES.items():
        made = [s.format(w) for w in wordings for s in STATEMENTS] + [f"SPDX-License-Identifier: {name}", *HEADINGS.get(name, [])]
        made += [bare for w in wordings if len(worded(bare := ARTICLE.sub("", w))[0]) > 1 and (re.search("licen[sc]e|[0-9]|dedication", bare, re.I))]
        made += [f"{ARTICLE.sub('', w)}-licensed" for w in wordings if WORD.fullmatch(ARTICLE.sub("", w).lower())]
        if "-" in name and name[-1].isdigit():
            made.append(name)
        if not name.startswith("CC"):
            made += [f"{name}-{x}" for x in ("only", "or-later") if "-" in name and name[-1].isdigit()]
            made += [f"SPDX-License-Identifier: {name}-{x}" for x in ("only", "or-later")]
        out.append(Template(name, "statement", tuple(dict.fromkeys(map(worded_, made)))))
    for name, texts in NOTICES.items():
        out += [Template(name, "notice", (worded_(x),)) for x in texts]
    for file in sorted(files(__package__).joinpath("templates").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            out.append(Template(file.name.removesuffix(".txt"), "text", (worded_(file.read_text(encoding="utf-8")),)))
    return out


@lru_cache(1)
def templates() -> dict[str, list[tuple[str, list[str]]]]:
    """Of each license its wordings: kind and words."""
    out: dict[str, list[tuple[str, list[str]]]] = {}
    for t in sheets():
        out.setdefault(t.license, []).extend((t.kind, list(w)) for w in t.wordings)
    return out


@lru_cache(1)
def compressors() -> tuple:
    """Without a dictionary, and with each template as one."""
    import zstandard

    made = []
    for t in sheets():
        held = zstandard.ZstdCompressionDict(". ".join(" ".join(w) for w in t.wordings).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=9)
        made.append(zstandard.ZstdCompressor(level=9, dict_data=held))
    return zstandard.ZstdCompressor(level=9), made


@lru_cache(1)
def statements() -> dict[tuple[str, ...], list[tuple[tuple[str, ...], int, int]]]:
    """Statements by their rarest pair of words (that of fewest sheets; a lone word by itself): statement, place of the pair, sheet."""
    made = [(w, k) for k, t in enumerate(sheets()) if t.kind == "statement" for w in t.wordings]
    holds: dict[tuple[str, ...], set[int]] = {}
    for w, k in made:
        for x in paired(w):
            holds.setdefault(x, set()).add(k)
    out: dict[tuple[str, ...], list[tuple[tuple[str, ...], int, int]]] = {}
    for w, k in made:
        every = paired(w)
        at = min(range(len(every)), key=lambda x: (len(holds[every[x]]), x))  # noqa: B023
        out.setdefault(every[at], []).append((w, at, k))
    for of in out.values():
        of.sort(key=lambda x: -len(x[0]))
    return out


def paired(words: tuple[str, ...]) -> list[tuple[str, ...]]:
    """Neighbouring words, or the only one."""
    return list(zip(words, words[1:], strict=False)) if len(words) > 1 else [tuple(words)]


@lru_cache(1)
def longest_statement() -> int:
    return max(len(w) for t in sheets() if t.kind == "statement" for w in t.wordings)


@lru_cache(1)
def telling() -> tuple[dict[tuple[str, str], list[int]], dict[int, tuple[int, int]]]:
    """Notices and whole texts by pair of words; and of each how many of its pairs must be left, in how many words.

    Of n words at most MISSING are missing, each of which takes two pairs, and at most BETWEEN stand between, each of
    which takes one. So nothing within the limits has fewer pairs.
    """
    of: dict[tuple[str, str], list[int]] = {}
    limits = {}
    for k, t in enumerate(sheets()):
        if t.kind != "statement":
            words = tuple(map(plain_word, t.wordings[0]))
            n, between = len(words), int(BETWEEN * len(words))
            limits[k] = (n - 1 - 2 * int(MISSING * n) - between, n + between)
            for x in set(paired(words)):
                of.setdefault(x, []).append(k)
    return of, limits


@lru_cache(1)
def spoken() -> frozenset[str]:
    """Words of all statements."""
    return frozenset(x for t in sheets() if t.kind == "statement" for w in t.wordings for x in w)


def long_blocks(words: list[str]) -> list[tuple[int, int, int]]:
    """Where notices and whole texts may stand: template, first word, end; overlapping ones of a template are one."""
    of, limits = telling()
    hits: dict[int, list[int]] = {}
    plain = list(map(plain_word, words))
    for at, x in enumerate(zip(plain, plain[1:], strict=False)):
        for k in of.get(x, ()):
            hits.setdefault(k, []).append(at)
    out = []
    for k, places in sorted(hits.items()):
        least, length = limits[k]
        block = None
        for first, last in zip(places, places[least - 1 :], strict=False):
            if last + 2 - first > length:
                continue
            a, b = max(0, last + 2 - length), min(len(words), first + length)
            if block and a < block[1]:
                block[1] = b
            else:
                block = [a, b]
                out.append((k, block))
    return [(k, a, b) for k, (a, b) in out]


def statement_blocks(words: list[str]) -> Iterator[tuple[int, int, list[tuple[int, tuple[str, ...]]]]]:
    """Blocks around rare pairs of statements that stand near each other: first word, end, and where the pairs stand."""
    of, cluster = statements(), []
    for at, word in enumerate(words):
        for x in ((word,), (word, words[at + 1]) if at + 1 < len(words) else ()):
            if x in of:
                if cluster and at - cluster[0][0] > CLUSTER:
                    yield max(0, cluster[0][0] - longest_statement()), min(len(words), cluster[-1][0] + longest_statement() + 1), cluster
                    cluster = []
                cluster.append((at, x))
    if cluster:
        yield max(0, cluster[0][0] - longest_statement()), min(len(words), cluster[-1][0] + longest_statement() + 1), cluster


KEYWORD = re.compile(KEYWORDS, re.I)


@lru_cache(1)
def legal_left() -> tuple[int, int]:
    """How many parts of LEGAL, and words with one, are left in every notice and whole text within the limits.

    Those that must be whole are aside, they hold a keyword. Each word counts for the first part that it holds, so a
    missing word takes one of one part, and the parts that few words hold go first.
    """
    parts, words = [], []
    for t in sheets():
        allowed = int(MISSING * len(t.wordings[0]))
        if t.kind != "statement" and allowed:
            counts = sorted(Counter(m[0] for w in t.wordings[0] if (m := [x for x in PARTS if x in w])).values())
            words.append(sum(counts) - allowed)
            while counts and counts[0] <= allowed:
                allowed -= counts.pop(0)
            parts.append(len(counts))
    return min(parts), min(words)


def likely(text: Column) -> Column:
    """False for texts without any name, statement, notice or whole text within the limits, by parts of words and keywords."""

    def told(low: Column) -> Column:
        every = [(reduce(lambda x, y: x & y, map(low.contains, parts)), pattern) for parts, pattern in QUICK]
        some = reduce(lambda x, y: x | y, (x if pattern is None else x & low.rlike(pattern) for x, pattern in every))
        legal = reduce(lambda x, y: x + y, (low.contains(x).cast("int") for x in PARTS))
        parts, words = legal_left()
        return some | ((legal >= parts) & (F.regexp_count(low, F.lit(LEGAL)) >= words))

    return F.exists(F.array(F.lower(text)), told)  # lower-cased once


@lru_cache(1 << 12)
def ranked(block: str, of: tuple[int, ...]) -> list[tuple[int, int]]:
    """Of these templates those that save enough of the block's compressed size as a dictionary: bytes saved, number; best first."""
    plain, made = compressors()
    data = block.encode("utf-8", "surrogatepass")
    alone = len(plain.compress(data))
    saved = sorted(((alone - len(made[k].compress(data)), k) for k in of), key=lambda x: (-x[0], x[1]))
    best = saved[0][0]
    kind = lambda k: sheets()[k].kind
    enough = lambda s, k: kind(k) == "statement" or s >= LEAST_SHARE * alone
    return [(s, k) for s, k in saved if enough(s, k) and s >= min(best * OF_BEST[kind(k)], best - SLACK)]


@lru_cache(1 << 12)
def saving(block: str, k: int) -> tuple[int, float]:
    """Bytes and share of the block's compressed size that one template saves."""
    plain, made = compressors()
    data = block.encode("utf-8", "surrogatepass")
    alone = len(plain.compress(data))
    saved = alone - len(made[k].compress(data))
    return saved, saved / alone


def plain_word(word: str) -> str:
    """Spellings of one word as one: licence, and versions with v in front or .0 behind."""
    return "license" if word == "licence" else VERSION.sub(r"\1", word)


VERSION = re.compile(r"^v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*$")


@lru_cache(None)
def identity(name: str, wording: tuple[str, ...]) -> list[tuple[int, int]]:
    """Where the words that identify the license stand in its notice: first, end."""
    out = []
    for run in IDENTITY.get(name, []):
        told = worded(run)[0]
        at = next(k for k in range(len(wording)) if list(wording[k : k + len(told)]) == told)
        out.append((at, at + len(told)))
    return out


def ends(words: list[str], wording: list[str]) -> list[int]:
    """Places where a notice may end. None is lost: a notice within the limits costs at most 2 * len(wording) here.

    Missing words cost 1 / MISSING, words between 1 / BETWEEN, and words in front nothing; the least cost of every
    end is found a word of the wording at a time.
    """
    n, known = len(wording), {w: k for k, w in enumerate(dict.fromkeys(wording))}
    coded = np.array([known.get(w, -1) for w in words], np.int64)
    missing, between, step = 1 / MISSING, 1 / BETWEEN, np.arange(len(words) + 1) / BETWEEN
    cost = np.zeros(len(words) + 1)
    for w in wording:
        fresh = cost + missing
        fresh[1:] = np.minimum(fresh[1:], np.where(coded == known[w], cost[:-1], np.inf))
        cost = np.minimum.accumulate(fresh - step) + step
    last = {known[w] for w in wording[n - 1 - int(MISSING * n) :]}
    return [k for k in (np.flatnonzero(cost[1:] <= 2 * n + 1e-6) + 1).tolist() if coded[k - 1] in last]


def aligned(words: list[str], wording: list[str], end: int) -> tuple[int, list[tuple[int, int]]] | None:
    """Of the notices that end there the one with fewest words missing and between: where it begins, and pairs (wording, words)."""
    n = len(wording)
    low = max(0, end - n - int(BETWEEN * n))
    tail, m = wording[::-1], end - low
    seen = words[low:end][::-1]
    rows = [[0] * (m + 1)]  # common words of the last k of the wording and the last j of the words
    for w in tail:
        above, row = rows[-1], [0] * (m + 1)
        for j in range(1, m + 1):
            row[j] = above[j - 1] + 1 if seen[j - 1] == w else max(above[j], row[j - 1])
        rows.append(row)
    fit = [(n + j - 2 * c, j) for j, c in enumerate(rows[n]) if n - c <= MISSING * n and j - c <= BETWEEN * n]
    if not fit:
        return None
    _, j = min(fit)
    start, k, pairs = end - j, n, []
    while k and j:
        if seen[j - 1] == tail[k - 1]:
            pairs.append((n - k, end - j))
            k, j = k - 1, j - 1
        elif rows[k - 1][j] >= rows[k][j - 1]:
            k -= 1
        else:
            j -= 1
    return start, pairs


Place = tuple[int, int, list[str], list[str]]  # first word, end, the wording's words that are missing, words between


def notices(words: list[str], wording: tuple[str, ...], name: str) -> list[Place]:
    """A notice's places that don't overlap, those with fewest words missing and between.

    The words that identify its license must stand there whole, in any spelling; other spellings count as differences.
    """
    made, told = [], identity(name, wording)
    plain, wanted = [plain_word(w) for w in words], [plain_word(w) for w in wording]
    for end in ends(plain, wanted):
        got = aligned(plain, wanted, end)
        if got:
            start, pairs = got
            at = dict(pairs)
            if not all(b - 1 in at and plain[max(0, at[b - 1] + 1 - (b - a)) : at[b - 1] + 1] == wanted[a:b] for a, b in told):
                continue
            pairs = [(k, x) for k, x in pairs if words[x] == wording[k]]
            own, there = {k for k, _ in pairs}, {k for _, k in pairs}
            made.append((start, end, [w for k, w in enumerate(wording) if k not in own], [words[k] for k in range(start, end) if k not in there]))
    return fewest(made)


def fewest(made: list[Place]) -> list[Place]:
    """Of places that overlap, those with fewest differences."""
    taken = Taken()
    return [x for x in sorted(made, key=lambda x: (len(x[2]) + len(x[3]), x[0], x[1])) if taken.add(x[0], x[1])]


@lru_cache(None)
def anchors(wording: tuple[str, ...]) -> dict[tuple[str, ...], int]:
    """Runs of ANCHOR words that stand once in the wording, and where."""
    every = list(zip(*(wording[k:] for k in range(ANCHOR)), strict=False))
    count = Counter(every)
    return {g: k for k, g in enumerate(every) if count[g] == 1}


def rising(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of the hits (place, place in the wording) that rises in both."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, t) in enumerate(hits):
        at = bisect_left(tops, t)
        before.append(last[at - 1] if at else -1)
        if at == len(tops):
            tops.append(t)
            last.append(k)
        else:
            tops[at], last[at] = t, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(hits[k])
        k = before[k]
    return out[::-1]


def whole_texts(words: list[str], wording: tuple[str, ...]) -> list[Place]:
    """Places of a whole license text, at most MISSING of it missing and BETWEEN between; anchors tell where to compare.

    Windows of the words begin every eighth of the text's length and are long enough for the text and all that may
    stand between, so a place is seen whole by one of them. Words between two anchors are compared one by one.
    """
    at, n = anchors(wording), len(wording)
    hits = [(k, at[g]) for k, g in enumerate(zip(*(words[k:] for k in range(ANCHOR)), strict=False)) if g in at]
    places_, made, step = [k for k, _ in hits], [], max(1, n // 8)
    if len(hits) < len(at) // 4:
        return []
    for begin in sorted({k // step * step for k in places_}):
        window = hits[bisect_left(places_, begin) : bisect_left(places_, begin + int(n * (1 + BETWEEN)) + 2 * step)]
        chain = rising(window)
        if len(chain) < len(at) // 4:
            continue
        middle = sorted(k - t for k, t in chain)[len(chain) // 2]
        chain = rising([(k, t) for k, t in window if abs(k - t - middle) <= (MISSING + BETWEEN) * n])
        got = compared(words, wording, chain)
        if got and len(got[2]) <= MISSING * n and len(got[3]) <= BETWEEN * n:
            made.append(got)
    return fewest([x for k, x in enumerate(made) if x not in made[:k]])


def common(one: tuple[str, ...], other: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common part of two gaps, exact up to EXACT pairs of words; beyond, of their longest common runs."""
    if len(one) * len(other) > EXACT:
        return [(m.a + x, m.b + x) for m in SequenceMatcher(None, one, other, autojunk=False).get_matching_blocks() for x in range(m.size)]
    rows = [[0] * (len(other) + 1)]
    for w in one:
        above, row = rows[-1], [0]
        for j, x in enumerate(other):
            row.append(above[j] + 1 if x == w else max(above[j + 1], row[j]))
        rows.append(row)
    k, j, out = len(one), len(other), []
    while k and j:
        if one[k - 1] == other[j - 1]:
            k, j = k - 1, j - 1
            out.append((k, j))
        elif rows[k - 1][j] >= rows[k][j - 1]:
            k -= 1
        else:
            j -= 1
    return out


def outer(told: list[int], pairs: dict[int, int], core: int) -> list[int]:
    """Of the wording's words before or behind all anchors, nearest first, those that cost more words between than they save, by the limits."""
    gain, best, keep, last = 0, 0, 0, core
    for n, t in enumerate(told, 1):
        gain += 1 / MISSING - (abs(last - pairs[t]) - 1) / BETWEEN
        last = pairs[t]
        if gain > best:
            best, keep = gain, n
    return told[keep:]


def compared(words: list[str], wording: tuple[str, ...], chain: list[tuple[int, int]]) -> Place | None:
    """The text's place that the chain of anchors spans, with what lies before, between and behind them."""
    pairs: dict[int, int] = {}
    if not chain:
        return None
    apart = chain[:1]  # anchors that overlap agree on where their words stand
    for k, t in chain[1:]:
        k0, t0 = apart[-1]
        if k - t == k0 - t0 or min(k - k0, t - t0) >= ANCHOR:
            apart.append((k, t))
    chain = apart
    for k, t in chain:
        for x in range(ANCHOR):
            pairs[t + x] = k + x
    lead, rest = chain[0][1], len(wording) - chain[-1][1]
    fixed = [(chain[0][0] - lead - ANCHOR - 1, -1), *chain, (chain[-1][0] + rest + ANCHOR, len(wording))]
    for (k, t), (k2, t2) in zip(fixed[:-1], fixed[1:], strict=True):
        lo, tlo = max(0, k + (ANCHOR if t >= 0 else 0)), max(0, t + (ANCHOR if t >= 0 else 1))
        hi = min(len(words), k2)
        if lo < hi and tlo < t2 and hi - lo <= GAP_WORDS and t2 - tlo <= GAP_WORDS:
            pairs.update((tlo + x, lo + y) for x, y in common(wording[tlo:t2], words[lo:hi]))
    for t in outer(sorted((t for t in pairs if t < chain[0][1]), reverse=True), pairs, chain[0][0]) + outer(
        sorted(t for t in pairs if t >= chain[-1][1] + ANCHOR), pairs, chain[-1][0] + ANCHOR - 1
    ):
        del pairs[t]
    start, end = min(pairs.values()), max(pairs.values()) + 1
    there = set(pairs.values())
    return start, end, [w for k, w in enumerate(wording) if k not in pairs], [words[k] for k in range(start, end) if k not in there]


def said(words: list[str], number: int, cluster: list[tuple[int, tuple[str, ...]]], free: dict[int, bool]) -> list[tuple[int, int]]:
    """Places of one sheet's statements around the pairs, the longest first; words that are taken don't count."""
    made = []
    for at, x in cluster:
        for wording, within, k in statements()[x]:
            a, b = at - within, at - within + len(wording)
            if k == number and a >= 0 and tuple(words[a:b]) == wording and all(free[n] for n in range(a, b)):
                made.append((a, b))
    taken = Taken()
    return [x for x in sorted(set(made), key=lambda x: (x[0] - x[1], x[0])) if taken.add(*x)]


def confirmed(words: list[str]) -> Iterator[tuple[int, Place]]:
    """Places of statements, notices and whole texts whose templates win their blocks, each held against the words exactly.

    A round ranks the sheets whose rare pairs are left in a block, and those near the best are looked for; the longest
    place is taken, and the next round goes on without its words. Sheets looked for in vain are set aside in that block. Words that
    no statement has aren't compressed. Of statements that overlap, from blocks that do, the longest stays.
    """
    stated = []
    for a, b, cluster in statement_blocks(words):
        free, vain = dict.fromkeys(range(a, b), True), set()
        while True:
            cluster = [(at, x) for at, x in cluster if all(free[at + k] for k in range(len(x)))]
            rivals = tuple(sorted({k for _, x in cluster for _, _, k in statements()[x]} - vain))
            if not rivals:
                break
            rest = " ".join(words[k] for k in range(a, b) if free[k] and words[k] in spoken())
            best = ranked(rest, rivals)
            found = [(s, k, x) for s, k in best for x in said(words, k, cluster, free)]
            vain |= {k for _, k in best} - {k for _, k, _ in found}
            if not found:
                continue
            _, number, _ = min(found, key=lambda f: (f[2][0] - f[2][1], -f[0], f[1]))
            longest = max(y - x for _, k, (x, y) in found if k == number)
            for _, k, (x, y) in found:
                if k == number and y - x == longest:
                    free.update((at, False) for at in range(x, y))
                    stated.append((x, y, number))
    taken = Taken()
    yield from ((k, (x, y, [], [])) for x, y, k in sorted(stated, key=lambda f: (f[0] - f[1], f)) if taken.add(x, y))
    every = long_blocks(words)
    for number, a, b in every:
        rivals = tuple(sorted({k for k, x, y in every if x < b and a < y}))
        if number not in {k for _, k in ranked(" ".join(words[a:b]), rivals)}:
            continue
        t = sheets()[number]
        look = notices(words[a:b], t.wordings[0], t.license) if t.kind == "notice" else whole_texts(words[a:b], t.wordings[0])
        yield from ((number, (a + x, a + y, *unlike)) for x, y, *unlike in look)


class Taken:
    """Ranges that don't overlap."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """False if the range overlaps one that is there."""
        k = bisect_left(self.starts, end)
        if k and self.ends[k - 1] > start:
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


def found_in(text: str) -> list[dict]:
    """Licenses of a text, in order of place: license, kind, start and end in characters, saved, missing, between.

    Of places that overlap that one stays whose template saves most of the compressed size of the words there; of equal
    ones that with fewest differences. A statement within a larger place of its license is part of that.
    """
    words, spans = worded(text)
    found = [(k, spans[a][0], spans[b - 1][1], " ".join(words[a:b]), *unlike) for k, (a, b, *unlike) in confirmed(words)]
    made, taken, of_license = [], Taken(), {}
    for number, a, b, block, missing, between in sorted(found, key=lambda x: (x[1] - x[2], x[1], x[0])):
        t = sheets()[number]
        if not of_license.setdefault(t.license, Taken()).add(a, b) and t.kind == "statement":
            continue
        saved, share = saving(block, number)
        made.append((-saved, len(missing) + len(between), t.license, a, b, share, t.kind, missing, between))
    out = []
    for saved, _, name, a, b, share, kind, missing, between in sorted(made):
        if taken.add(a, b):
            out.append({"license": name, "kind": kind, "start": a, "end": b, "saved_bytes": -saved, "saved_share": share, "missing": missing, "between": between})
    return sorted(out, key=lambda x: x["start"])


RESULT = "license string, kind string, start long, end long, saved_bytes long, saved_share double, missing array<string>, between array<string>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per license text, notice or statement in each text: id, license, kind, start, end, saved_bytes, saved_share, missing, between.

    Whole texts are read. start and end are offsets in characters; missing holds the words of the wording that the
    text lacks, between those that stand inside it. Texts without a name, notice or text of a license, null and empty texts have no row;
    repeated rows have theirs each. Other columns are not looked at.
    """
    schema = T.StructType([docs.schema[id_col]] + T._parse_datatype_string(RESULT).fields)
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
    some = docs.where(likely(F.col(text_col))).select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, text_col):
                places, rows = [], []
                for k, text in enumerate(part.column(text_col).to_pylist()):
                    got = found_in(text)
                    rows += got
                    places += [k] * len(got)
                ids = part.column(id_col).take(pa.array(places, pa.int64()))
                made = [pa.array([r[f.name] for r in rows], t) for f, t in zip(schema.fields[1:], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *made], schema.names)

    return in_small_batches(some).mapInArrow(freeing(run), schema)
