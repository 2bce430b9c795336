"""Licence scan by a positional rare-token index.

A first pass counts, over all texts, in how many of them each licence word stands. The index has
postings (template, position) of every licence word, highest idf first, down to the idf at which a
template can't be missed: the positions left out hold too little weight to be accepted without two
of those kept. A second pass looks up each file's words in the postings, the rarest licence words it
holds among them; every hit tells where its template would start, and starts on which two hits agree are
intersections of postings by relative position. There the template's share of idf weight found in
position is measured; it is accepted if that is enough and the template's key phrase stands in the text
at the place it predicts. Exact phrases of their own ("base") are found wherever their words stand in a row.

Defined results: a null or empty text has no words, no labels and score 0; repeated
rows give equal rows; an empty table gives an empty table; only the id and text
columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from placerec.llm import textkernel as K

# Phrases that are a label wherever their words stand in a row.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Fixed values: (label, licence wording, key phrase that must stand in position), in lower case without punctuation.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "to deal in the software without restriction"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license", "gnu general public license"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("lgpl-2-1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "either version 2 1 of the license"),
    ("lgpl-3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties", "provided with the distribution this software is provided by"),
    ("bsd-3", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "to alter it and redistribute it freely"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software released into the public domain"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", "any person or organization obtaining a copy of the software"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", "eclipse public license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated the work to the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced", "all rights reserved"),
]
LEAST_SHARE = 0.75


def vocabulary(base: dict[str, str] = BASE, templates=TEMPLATES) -> list[str]:
    return sorted({w for p in [*base, *(t[1] for t in templates)] for w in p.split()})


def _hashes(words: list[str]) -> np.ndarray:
    buf, offs = K.flat(pa.array(words))
    return K.span_hashes(buf, offs[:-1], offs[1:])


def _numbered(part: np.ndarray, at: np.ndarray, keys: np.ndarray, numbers: np.ndarray):
    """The licence word's number of each word of the texts (-1: none), and the words of each text."""
    part = K.LOWER[part]
    starts, ends, per = K.words(part, at, K.ALNUM_WORDS)
    h = K.span_hashes(part, starts, ends)
    i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[i] == h, numbers[i], -1).astype(np.int32), per


def document_frequencies(docs: DataFrame, words: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of texts, and in how many of them each of ``words`` stands, over all texts."""
    h = _hashes(words)
    order = np.argsort(h)
    keys, numbers = h[order], order.astype(np.int32)

    def run(batches):
        counts = np.zeros(len(words) + 1, np.int64)
        for batch in batches:
            buf, offs = K.flat(batch.column(0))
            for i, j, part, at in K.chunks(buf, offs):
                found, per = _numbered(part, at, keys, numbers)
                text = np.repeat(np.arange(j - i), per)
                hit = found >= 0
                pairs = np.unique(text[hit] * len(words) + found[hit])
                counts[:-1] += np.bincount(pairs % len(words), minlength=len(words))
                counts[-1] += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words) + 1), pa.int32()), pa.array(counts)], ["word", "n"])

    rows = docs.select(text_col).mapInArrow(K.releasing(run), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r.word: r.n for r in rows}
    return got.get(len(words), 0), {w: got.get(i, 0) for i, w in enumerate(words)}


def postings(plans: list, n_words: int, least: float = LEAST_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(templates, positions, offsets by word) of the highest-idf positions of each template.

    As many are kept as any acceptable match must hold two of: what the others weigh, with the heaviest kept one, stays under
    the least share. No match of two words or more is missed; wordings of the list have four at least.
    """
    rows = []
    for which, (_, seq, _, _, weight) in enumerate(plans):
        order = np.argsort(-weight, kind="stable")
        kept = 1
        while kept < len(seq) and 1 - weight[order[:kept]].sum() + weight[order[0]] >= least:
            kept += 1
        rows += [(int(seq[i]), which, int(i)) for i in order[:kept]]
    rows.sort()
    word = np.array([w for w, _, _ in rows])
    return np.array([t for _, t, _ in rows]), np.array([i for _, _, i in rows]), np.searchsorted(word, np.arange(n_words + 1))


def _starts(found: np.ndarray, hits: np.ndarray, index):
    """(template, starts) where two hits of a template's postings agree on its start."""
    template, position, offs = index
    w = found[hits]
    n = offs[w + 1] - offs[w]
    hits, w, n = hits[n > 0], w[n > 0], n[n > 0]
    if not len(hits):
        return
    at = np.repeat(offs[w] - np.cumsum(n) + n, n) + np.arange(n.sum())
    span = len(found) + int(position.max()) + 1
    key = template[at] * span + np.repeat(hits, n) - position[at] + int(position.max())
    key, votes = np.unique(key, return_counts=True)
    key = key[votes >= 2]
    which, start = key // span, key % span - int(position.max())
    for t in np.unique(which).tolist():
        yield t, start[which == t]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, templates=TEMPLATES) -> DataFrame:
    """Per text: its words, base places with the first and last, base and all labels, and a score."""
    words = vocabulary(base, templates)
    n_docs, freq = document_frequencies(docs, words, text_col)
    idf = np.array([math.log((n_docs + 1) / (freq[w] + 1)) + 1e-6 for w in words])
    number = {w: i for i, w in enumerate(words)}
    h = _hashes(words)
    order = np.argsort(h)
    keys, numbers = h[order], order.astype(np.int32)
    phrases = [([number[w] for w in p.split()], label) for p, label in base.items()]
    plans = []
    for label, wording, key in templates:
        seq, must = [number[w] for w in wording.split()], [number[w] for w in key.split()]
        place = next(i for i in range(len(seq)) if seq[i : i + len(must)] == must)
        plans.append((label, np.array(seq), place, len(must), idf[seq] / idf[seq].sum()))
    index = postings(plans, len(words))

    def run(batches):
        for batch in batches:
            buf, offs = K.flat(batch.column(1))
            for i, j, part, at in K.chunks(buf, offs):
                found, per = _numbered(part, at, keys, numbers)
                n, ends = j - i, np.cumsum(per)
                first_of = ends - per
                hits = np.flatnonzero(found >= 0)
                text_of = lambda w: np.searchsorted(ends, w, "right")
                base_of: dict[int, list[tuple[int, str]]] = {}
                for seq, label in phrases:
                    s = hits[found[hits] == seq[0]]
                    t = text_of(s)
                    ok = s + len(seq) <= ends[t] if len(s) else np.zeros(0, bool)
                    s, t = s[ok], t[ok]
                    for k in range(1, len(seq)):
                        ok = found[s + k] == seq[k]
                        s, t = s[ok], t[ok]
                    for x, y in zip(t.tolist(), (s - first_of[t]).tolist(), strict=True):
                        base_of.setdefault(x, []).append((y, label))
                more: dict[int, dict[str, float]] = {}
                for which, starts in _starts(found, hits, index):
                    label, seq, place, n_must, weight = plans[which]
                    # the predicted key phrase tells the text; a start may lie before it, if the text begins within the wording
                    t = text_of(starts + place)
                    ok = (starts + place >= 0) & (t < n)
                    starts, t = starts[ok], t[ok]
                    at_words = starts[:, None] + np.arange(len(seq))[None, :]
                    inside = (at_words >= first_of[t][:, None]) & (at_words < ends[t][:, None])
                    same = inside & (found[np.clip(at_words, 0, len(found) - 1)] == seq[None, :])
                    share = same @ weight
                    ok = (share >= LEAST_SHARE) & same[:, place : place + n_must].all(1)
                    for x, y in zip(t[ok].tolist(), share[ok].tolist(), strict=True):
                        got = more.setdefault(x, {})
                        got[label] = max(got.get(label, 0.0), y)
                rows = [sorted(base_of.get(x, ())) for x in range(n)]
                labels = [sorted({b for _, b in rows[x]} | more.get(x, {}).keys()) for x in range(n)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, n),
                    pa.array(per, pa.int64()),
                    pa.array([len(x) for x in rows], pa.int64()),
                    pa.array([x[0][0] if x else None for x in rows], pa.int64()),
                    pa.array([x[-1][0] if x else None for x in rows], pa.int64()),
                    pa.array([",".join(sorted({b for _, b in x})) for x in rows], pa.string()),
                    pa.array([",".join(x) for x in labels], pa.string()),
                    pa.array([1.0 if rows[x] else min(1.0, max(more[x].values())) if x in more else 0.0 for x in range(n)], pa.float64()),
                ], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    part = docs.select(id_col, text_col)
    return part.mapInArrow(K.releasing(run), f"`{id_col}` {part.schema[id_col].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
