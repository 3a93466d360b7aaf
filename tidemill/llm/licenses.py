"""License scans: a trained paragraph classifier, calibrated for the unknown, confirmed by templates.

Paragraphs are the lines of a text, and windows of WINDOW lines that overlap by half, so that a wrapped
notice is read as a whole. Their word 1- to 3-grams feed a sparse multinomial logistic regression
over licence families and one class for anything else, trained on variants of the paragraphs below and of
the usual statements: whole, cut, with words lost or changed, and among other words. A temperature and
the unknown class's bias are set on variants left out of the fit. A predicted family counts only if the
paragraph also holds at least half of the 3-grams of one of its templates, or one of its short names:
with "license", as an SPDX id, or an abbreviation called a licence.

Only paragraphs with a cue are read. Cues are words chosen so that more than half of any template's
3-grams hold one, and every short name holds one, so a paragraph without cues could not be confirmed.
Training runs on these few fixed texts; scoring is one expression over built-in functions.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Paragraphs of the public licence texts and of the notices they ask for, by family, as words.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "apache": [
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "licensed to the apache software foundation asf under one or more contributor license agreements see the notice file distributed with this work for additional information regarding copyright ownership the asf licenses this file to you under the apache license version 2.0",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program if not see",
    ],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        "you should have received a copy of the gnu lesser general public license along with this library if not write to the free software foundation",
    ],
    "agpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you should have received a copy of the gnu affero general public license along with this program if not see",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v. 2.0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "the contents of this file are subject to the mozilla public license version 1.1 the license you may not use this file except in compliance with the license",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
    ],
    "zlib": [
        "this software is provided as-is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required",
    ],
    "epl": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at",
        "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at",
    ],
    "cc": [
        "this work is licensed under the creative commons attribution 4.0 international license to view a copy of this license visit",
        "this work is licensed under a creative commons attribution sharealike 4.0 international license",
        "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    ],
}
#: Short names: what is confirmed wherever it stands (names with "license" and SPDX ids), and what only counts as it is called below.
_GNU = {"gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0")}
_GNU_IDS = {f: [f"{f}{m}{v}{s}" for v in versions for m in ("-", "v") for s in ("", "-only", "-or-later", "+")] + [f"{f}{m}{v[0]}{s}" for v in versions if v.endswith(".0") for m in ("-", "v") for s in ("", "+")] for f, versions in _GNU.items()}
NAMES = {
    "mit": ["mit license", "mit-0"], "apache": ["apache license", "apache software license", "apache-2.0", "apache-1.1", "apache-1.0"],
    "gpl": ["gnu general public license", "gnu gpl", *_GNU_IDS["gpl"]],
    "lgpl": ["gnu lesser general public license", "lesser general public license", "gnu library general public license", "gnu lgpl", *_GNU_IDS["lgpl"]],
    "agpl": ["gnu affero general public license", "affero general public license", "gnu agpl", *_GNU_IDS["agpl"]],
    "bsd": ["bsd license", "bsd 2-clause", "bsd 3-clause", "2-clause bsd", "3-clause bsd", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd"],
    "mpl": ["mozilla public license", "mpl-2.0", "mpl-1.1", "mpl-1.0"], "isc": ["isc license"],
    "zlib": ["zlib license", "zlib-acknowledgement"], "epl": ["eclipse public license", "epl-1.0", "epl-2.0"],
    "cc": ["creative commons license", "creative commons attribution", *(f"cc{m}by{k.replace('-', m, 1)}{m}{v}" for m in (" ", "-") for k in ("", "-sa", "-nc", "-nd", "-nc-sa", "-nc-nd") for v in ("3.0", "4.0")), *(f"cc by{k} {v}" for k in ("-sa", "-nc", "-nd", "-nc-sa", "-nc-nd") for v in ("3.0", "4.0")), "cc0-1.0", "cc0 1.0"],
    "unlicense": ["the unlicense"],
}
ABBREVIATIONS = {"mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "isc": "isc", "zlib": "zlib", "epl": "epl", "unlicense": "unlicense"}
CALLED = ("{} license", "license {}", "license the {}", "licensed under {}", "licensed under the {}", "released under {}", "released under the {}", "spdx-license-identifier {}")
STATEMENTS = ("licensed under {}", "released under {}", "this program is licensed under {}", "this project is distributed under the terms of {}", "see the file for {}", "{}")
#: What mentions licences without being one.
OTHERS = (
    "the license of the driver was taken by the police", "a license to fish is needed here", "please read the license agreement before you go on",
    "the public library is free to use for any person", "general terms and conditions of use", "all rights reserved", "copyright 2020 by the authors",
    "software version 2.0 was released in january", "version 3 of the program is out", "the foundation gives free copies of the work to any person",
    "permission to enter was not given", "you may obtain a copy at the desk", "conditions are met without restriction", "the apache helicopter", "a student at mit",
    "the bell was licensed for public use", "the source of the river", "modify the terms", "the notice appears in all copies of the paper",
    "the warranty of the car covers any damages for two years", "the authors were held liable for the claim in court", "the new library of the university holds rare copies of his work",
    "this program for young people is free and open to the public", "the contents of the box are subject to change without notice", "the museum was provided with permission to publish the pictures",
    "the eclipse was visible to the public in the north", "creative work in the commons of the village", "the general of the public guard spoke first", "in no event will the match be played without its captain",
    "the distribution of food in the hope that it will be useful to families", "he wrote the original song and a lesser known version of it", "you should have received a copy of the letter along with this parcel",
    "the product is sold as is and the buyer has no rights to a refund", "the board permits persons to sell goods at the fair subject to the usual fee", "documentation of the software is on the server of the company",
)
FAMILIES = (*TEMPLATES, "unknown")
#: Lines of a window, features kept, the least probability of a family, and the least share of a template's 3-grams.
WINDOW, MOST_FEATURES, LEAST_PROBABILITY, LEAST_SHARE = 24, 2500, 0.5, 0.5
_WORD = r"[^a-z0-9.+-]+"
#: Words that stand anywhere, never cues.
_COMMON = frozenset("including without following subject provided particular whether otherwise should received purpose either version option under about other which where there their person persons anyone".split())
#: Cues of the short names, as words start.
_NAME_CUES = ("licens", "licenc", "unlicens", "released under", "gnu", "gpl", "agpl", "lgpl", "mpl-", "epl-", "zlib-", "bsd", "0bsd", "mit-0", "apache-", "creative commons", "cc by", "cc-by", "cc0")


def words(text: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split(_WORD, text.lower())) if w]


def grams(tokens: list[str], sizes=(1, 2, 3)) -> list[str]:
    return [" ".join(tokens[i : i + n]) for n in sizes for i in range(len(tokens) - n + 1)]


@lru_cache(maxsize=1)
def cue_words() -> tuple[str, ...]:
    """Words such that of any template more than half of the 3-grams hold one; those that cover most come first, longer words before shorter."""
    open_ = [sorted(set(zip(t, t[1:], t[2:], strict=False))) for ts in TEMPLATES.values() for t in map(str.split, ts)]
    size, chosen = [len(o) for o in open_], []
    while left := [o for o, n in zip(open_, size, strict=True) if 2 * len(o) >= n * LEAST_SHARE * 2]:
        counts: dict[str, int] = {}
        for least in (6, 5, 4):
            for w in (w for o in left for g in o for w in set(g) if len(w) >= least and w.isalpha() and w not in _COMMON):
                counts[w] = counts.get(w, 0) + 1
            if counts:
                break
        chosen.append(min(counts, key=lambda w: (-counts[w], w)))
        open_ = [[g for g in o if chosen[-1] not in g] for o in open_]
    return tuple(chosen)


def cue() -> str:
    """A pattern for lower-case text: looked for where words start only, as there are many cues and long texts."""
    return f"(?<![a-z0-9]){one_of((*_NAME_CUES, *cue_words()))}"


def examples() -> list[tuple[list[str], int, int]]:
    """Words, family and number of other words around them; every fourth is left out of the fit."""
    out, draw = [], np.random.default_rng(17)
    spare = [w for t in OTHERS for w in t.split()]
    for y, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            tokens = template.split()
            half = len(tokens) // 2
            out += [(tokens, y, k) for k in (0, 0, 20, 60, 150, 300)]
            out += [(part, y, 0) for part in (tokens[:half], tokens[half:], tokens[half // 2 : half + half // 2])]
            for rate in (0.03, 0.06, 0.1, 0.15):  # words lost, or others in their place
                kept = [w if draw.random() > rate else str(draw.choice(spare)) for w in tokens if draw.random() > rate / 2]
                out.append((kept, y, int(draw.integers(0, 80))))
        called = [c.format(ABBREVIATIONS[family]) for c in CALLED if family in ABBREVIATIONS]
        after = [f"license {n}" for n in NAMES[family] if " " not in n]
        out += [(words(t), y, k) for t in (*NAMES[family], *after, *called) for k in (0, 0, 6)]
        out += [(words(s.format(n)), y, 0) for n in NAMES[family] if " " in n for s in STATEMENTS]
    for t in OTHERS:
        tokens = t.split()
        out += [(tokens, len(TEMPLATES), k) for k in (0, 0, 10, 60)]
        out += [([str(w) for w in draw.permutation(tokens)], len(TEMPLATES), 0), (tokens + str(draw.choice(OTHERS)).split(), len(TEMPLATES), 0)]
    # Text that says nothing about licences is unknown.
    out += [([f"{w}." for w in draw.choice(spare, 3)], len(TEMPLATES), k) for k in range(60)]
    return [(t, y, k) for t, y, k in out if t]


@lru_cache(maxsize=1)
def train(rounds: int = 80) -> tuple[dict[str, tuple[float, ...]], tuple[float, ...], float]:
    """Weights per n-gram and class, biases (the unknown class's calibrated), and the temperature."""
    rows = examples()
    y = np.array([r[1] for r in rows])
    found: dict[str, set[int]] = {}
    often: dict[str, int] = {}
    for tokens, label, _ in rows:
        for g in set(grams(tokens)):
            found.setdefault(g, set()).add(label)
            often[g] = often.get(g, 0) + 1
    # The n-grams of many rows and few classes say most.
    vocabulary = sorted(found, key=lambda g: (-often[g] / len(found[g]), g))[: MOST_FEATURES * 5 // 4]
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (tokens, _, others) in enumerate(rows):
        mine = [place[g] for g in set(grams(tokens)) if g in place]
        x[i, mine] = 1 / np.sqrt(max(1, len(tokens) + others))
    truth = np.eye(len(FAMILIES), dtype=np.float32)[y]
    held = np.arange(len(rows)) % 4 == 3

    def fitted(some: np.ndarray, w: np.ndarray, b: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 / np.bincount(y[some], minlength=len(FAMILIES)).clip(1))[y[some]][:, None].astype(np.float32) * some.sum() / len(FAMILIES)
        mine, hope = x[some], truth[some]
        for _ in range(rounds):
            p = _softmax(mine @ w + b)
            error = weight * (p - hope) / some.sum()
            w -= 40.0 * (mine.T @ error)
            b -= 1.0 * error.sum(axis=0)
            w = np.sign(w) * np.maximum(np.abs(w) - 40.0 * 1e-5, 0)  # the sparse part
        return w, b

    def kept(w: np.ndarray) -> np.ndarray:
        strong = np.argsort(-np.abs(w).max(axis=1), kind="stable")[:MOST_FEATURES]
        return strong[np.abs(w[strong]).max(axis=1) > 0]

    w, b = fitted(~held, np.zeros((len(vocabulary), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32), rounds)
    some = kept(w)
    scores = x[held][:, some] @ w[some] + b

    def loss(t: float, shift: float) -> float:
        moved = scores.astype(np.float64) / t
        moved[:, -1] += shift
        each = -np.log(_softmax(moved)[np.arange(held.sum()), y[held]] + 1e-12)
        return float(np.mean([each[y[held] == k].mean() for k in set(y[held].tolist())]))  # classes weigh the same

    temperature, shift = min(((t, u) for t in (0.15, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0) for u in np.arange(-3, 3.25, 0.25)), key=lambda c: loss(*c))
    w, b = fitted(np.ones(len(rows), bool), w, b, rounds // 4)
    bias = [float(v) for v in b]
    bias[-1] += float(shift) * temperature
    return {vocabulary[i]: tuple(round(float(v), 6) for v in w[i]) for i in kept(w)}, tuple(round(v, 6) for v in bias), float(temperature)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _texts(values) -> Column:
    """An array of texts, handed to Spark as one, which folds it into a literal before the query runs."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def _numbers(values, kind: str) -> Column:
    """An array of numbers, likewise."""
    return _texts(map(repr, values)).cast(f"array<{kind}>")


def classify(paragraph: Column) -> Column:
    """struct(family, probability, share) of a paragraph: family by the classifier, share of its best template's 3-grams, or 1 if it holds a short name."""
    weights, bias, temperature = train()
    # Each table is one literal: n-grams, their weights end to end, biases, and the numbers of the classes.
    vocabulary = _texts(sorted(weights))
    table, biases, classes = _numbers((w for g in sorted(weights) for w in weights[g]), "double"), _numbers(bias, "double"), _numbers(range(len(FAMILIES)), "int")
    # Words that no n-gram, template or name holds become one mark for each run of them: what is left is short.
    clean = F.regexp_replace(F.regexp_replace(F.lower(paragraph), _WORD, " "), r"(?<![^ ])\.+|\.+(?![^ ])", "")
    known = F.regexp_replace(F.regexp_replace(clean, f"(?<![^ ])(?!{one_of(known_words())}(?![^ ]))[^ ]+", "~"), "~(?: ++~)++", "~")  # possessive: a plain loop over a long text would overflow the stack
    given = F.struct(F.filter(F.split(known, " +"), lambda w: w != "").alias("tokens"), F.greatest(F.regexp_count(clean, F.lit("[^ ]+")), F.lit(1)).alias("n"))
    join = lambda t, i, n: F.array_join(F.slice(t, i, n), " ")

    def of_tokens(v: Column) -> Column:
        t = v["tokens"]
        upto = lambda n: F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        of_size = lambda n: F.transform(upto(n), lambda i: join(t, i, n))
        each = F.array_distinct(F.concat(*map(of_size, (1, 2, 3))))
        threes = F.array_distinct(F.transform(upto(3), lambda i: join(t, i, 3)))
        # An intersection hashes; only the few n-grams that are left are looked up from end to end.
        rows = F.transform(F.array_intersect(each, vocabulary), lambda g: ((F.array_position(vocabulary, g) - 1) * len(FAMILIES)).cast("int"))
        total = lambda at, k: F.aggregate(at, F.lit(0.0), lambda a, i: a + F.get(table, i + k))
        scores = let(rows, lambda at: F.transform(classes, lambda k: (total(at, k) / F.sqrt(v["n"].cast("double")) + F.get(biases, k)) / temperature))
        return let(F.struct(scores.alias("scores"), threes.alias("threes"), F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")).alias("line")), decide)

    def decide(v: Column) -> Column:
        top = F.array_max(v["scores"])
        total = F.aggregate(v["scores"], F.lit(0.0), lambda a, s: a + F.exp(s - top))
        family = F.element_at(_texts(FAMILIES), F.array_position(v["scores"], top).cast("int"))
        shares = [
            F.when((family == name) & v["line"].rlike(named(name)), F.lit(1.0)).when(family == name, F.greatest(*(_share(v["threes"], t) for t in (*TEMPLATES[name], TEMPLATES[name][0]))))
            for name in TEMPLATES
        ]
        return F.struct(family.alias("family"), (1 / total).alias("probability"), F.coalesce(*shares, F.lit(0.0)).alias("share"))

    return let(given, of_tokens)


@lru_cache(maxsize=1)
def known_words() -> tuple[str, ...]:
    """Every word of the n-grams kept, the templates and the short names."""
    called = [c.format(a) for a in ABBREVIATIONS.values() for c in CALLED]
    texts = [*train()[0], *(t for ts in TEMPLATES.values() for t in ts), *(n for ns in NAMES.values() for n in ns), *called]
    return tuple(sorted({w for t in texts for w in t.split()}))


def one_of(words: tuple[str, ...]) -> str:
    """A pattern for one of the words that shares their beginnings, so that a text is read about once."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(at: dict) -> str:
        parts = [re.escape(c) + written(rest) for c, rest in at.items() if c]
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)}){'?' if '' in at else ''}"

    return written(tree)


def named(family: str) -> str:
    """A pattern for a line of words, in blanks, that holds a short name of the family."""
    called = [c.format(ABBREVIATIONS[family]) for c in CALLED if family in ABBREVIATIONS]
    return f" ({'|'.join(re.escape(n) for n in sorted({*NAMES[family], *called}))}) "


def _share(threes: Column, template: str) -> Column:
    """The share of a template's 3-grams that a paragraph holds."""
    own = sorted(set(grams(template.split(), (3,))))
    return F.size(F.array_intersect(threes, _texts(own))).cast("double") / len(own)


def paragraphs(text: Column) -> Column:
    """The lines with a cue, and of texts of several lines the windows with one."""
    some = cue()
    starts = lambda n: F.when(n > 1, F.sequence(F.lit(1), F.greatest(n - WINDOW // 2, F.lit(1)), F.lit(WINDOW // 2))).otherwise(F.array().cast("array<int>"))
    windows = lambda lines: F.transform(starts(F.size(lines)), lambda i: F.array_join(F.slice(lines, i, WINDOW), " "))
    both = let(F.split(F.lower(text), "\n"), lambda lines: F.concat(F.filter(lines, lambda x: x.rlike(some)), F.filter(windows(lines), lambda x: x.rlike(some))))
    return F.when(F.lower(text).rlike(some), both).otherwise(F.array().cast("array<string>"))


def find_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs (lines and windows with a cue), families (confirmed, sorted, comma-joined) and probability (the highest of those).

    Null text is empty; null doc_ids and repeated rows get a row each; an empty table gives none; without
    a confirmed family, families is empty and probability 0. Columns besides doc_id and text are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), paragraphs(text).alias("paragraphs"))
    held = held.withColumn("found", F.when(F.size("paragraphs") > 0, F.transform("paragraphs", classify)))
    good = F.filter("found", lambda c: (c["family"] != "unknown") & (c["probability"] >= LEAST_PROBABILITY) & (c["share"] >= LEAST_SHARE))
    held = held.withColumn("good", good)
    return held.select(
        "doc_id", F.size("paragraphs").cast("long").alias("n_paragraphs"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("good", lambda c: c["family"]))), ","), F.lit("")).alias("families"),
        F.coalesce(F.array_max(F.transform("good", lambda c: c["probability"])), F.lit(0.0)).alias("probability"),
    )
