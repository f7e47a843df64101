"""License scans by conditional compression.

A candidate block is a line or sentence with a license cue, and a sentence over several lines
of a paragraph where a wording crosses a line end.  Its normalised words are compressed plainly
and with each template as a raw zstandard dictionary; the bytes that a template saves rank the
templates.  Each that saves enough is then held against the block word by word: the core of a
wording (license name and version) must stand in the block unbroken and not go on into another
license's name, and the differences of the rest are counted and reported.  Every license
confirmed is reported, best ranked first.

Only texts with a cue reach Python, nothing is shuffled, and whole texts are read.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizloom.llm.common import free_name, prepare

#: Words that mark a block worth a look, beside the first words of templates that hold none of these.
CUES = (r"(?i)licen[sc]|copyright|spdx|public\W+domain|creative\W+commons|all\W+rights\W+reserved|"
       r"permission\W+is\W+hereby|redistribution\W+and\W+use|\bCC\W+BY\b|\bCC0\b|unlicense")
#: Between a sentence's end and the next; "v. 2.0" is one word.
_STOP = r"(?:(?<!\W[vV]\.)|(?!\s*\d))\s+"
_BLOCK = re.compile(r"\n+|(?<=\w[.!?;])" + _STOP)
#: Sentences of a paragraph, which ends at a line without words; a license's sentence may go on after a semicolon.
_SENTENCE = re.compile(r"\n(?:[^\w\n]*\n)+|(?<=\w[.!?])" + _STOP)
_WORD = re.compile(r"[^\W_]+")
#: Bytes a template must save.
LEAST_SAVED = 4
LEVEL = 9
#: Where so many words of a wording stand outside its core, the share of them that may differ.
LONG_LEAD, MAY_DIFFER = 6, 0.6

#: Wordings in public use.  [core]: must stand unbroken.
TEMPLATES = {
    "MIT": ["Released under the [MIT License]", "Licensed under the [MIT license]", "[SPDX-License-Identifier: MIT]",
            "[Licensed under MIT]", "[License: MIT]",
            "[Permission is hereby granted, free of charge, to any person obtaining a copy of this software] and associated "
            "documentation files (the Software), to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the [Apache License, Version 2.0]", "Released under the [Apache License 2.0]",
                   "[SPDX-License-Identifier: Apache-2.0]"],
    "GPL-3.0": ["This work is licensed under the [GNU General Public License, version 3]", "Released under the [GNU GPL v3]", "Released under the [GNU GPL version 3]",
                "[Licensed under GPLv3]", "[Licensed under the GPLv3]",
                "under the terms of the [GNU General Public License v3]", "Licensed under [GPL-3.0]",
                "[GNU General Public License as published by the Free Software Foundation, either version 3]"],
    "GPL-2.0": ["This work is licensed under the [GNU General Public License, version 2]", "Released under the [GNU GPL v2]", "Released under the [GNU GPL version 2]",
                "[Licensed under GPLv2]", "[Licensed under the GPLv2]",
                "under the terms of the [GNU General Public License v2]", "Licensed under [GPL-2.0]",
                "[GNU General Public License as published by the Free Software Foundation, either version 2]"],
    "LGPL-3.0": ["This work is licensed under the [GNU Lesser General Public License, version 3]", "Licensed under [LGPL-3.0]"],
    "LGPL-2.1": ["This work is licensed under the [GNU Lesser General Public License, version 2.1]", "Licensed under [LGPL-2.1]"],
    "AGPL-3.0": ["This work is licensed under the [GNU Affero General Public License, version 3]", "Licensed under [AGPL-3.0]"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the [Mozilla Public License, v. 2.0]",
                "Licensed under the [Mozilla Public License 2.0]", "Licensed under the [Mozilla Public License, version 2.0]"],
    "BSD-3-Clause": ["Released under the [BSD 3-Clause License]", "SPDX-License-Identifier: [BSD-3-Clause]",
                     "[Neither the name of the copyright holder nor the names of its contributors may be used to endorse] or "
                     "promote products derived from this software"],
    "BSD-2-Clause": ["Released under the [BSD 2-Clause License]", "SPDX-License-Identifier: [BSD-2-Clause]"],
    "ISC": ["Released under the [ISC License]", "[Permission to use, copy, modify, and/or distribute this software for any "
            "purpose with or without fee is hereby granted]"],
    "CC-BY-4.0": ["Licensed under [CC BY 4.0]", "This work is licensed under a [Creative Commons Attribution 4.0] International License"],
    "CC-BY-SA-4.0": ["Licensed under [CC BY-SA 4.0]",
                     "This work is licensed under a [Creative Commons Attribution-ShareAlike 4.0] International License"],
    "CC-BY-NC-4.0": ["Licensed under [CC BY-NC 4.0]",
                     "This work is licensed under a [Creative Commons Attribution-NonCommercial 4.0] International License"],
    "CC-BY-ND-4.0": ["Licensed under [CC BY-ND 4.0]",
                     "This work is licensed under a [Creative Commons Attribution-NoDerivatives 4.0] International License"],
    "CC-BY-NC-SA-4.0": ["Licensed under [CC BY-NC-SA 4.0]", "This work is licensed under a "
                        "[Creative Commons Attribution-NonCommercial-ShareAlike 4.0] International License"],
    "CC-BY-NC-ND-4.0": ["Licensed under [CC BY-NC-ND 4.0]", "This work is licensed under a "
                        "[Creative Commons Attribution-NonCommercial-NoDerivatives 4.0] International License"],
    "CC0-1.0": ["Released under [CC0 1.0]", "Dedicated to the public domain under [CC0]"],
    "Unlicense": ["[This is free and unencumbered software released into the public domain]"],
    "Proprietary": ["Copyright holder. [All rights reserved]"],
}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def cue_of(templates: dict[str, list[str]]) -> str:
    """A pattern that some place of every wording meets: ``CUES``, or a core's first three words."""
    cores = [m[1] if (m := re.search(r"\[(.*)\]", x)) else x for v in templates.values() for x in v if not re.search(CUES, x)]
    firsts = sorted({r"\W+".join(words_of(c)[:3]) for c in cores if words_of(c)})
    return CUES + "".join(rf"|\b{f}\b" for f in firsts)


@dataclass(frozen=True)
class Wording:
    words: tuple[str, ...]
    core: tuple[str, ...]


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        def wording(x):
            core = re.search(r"\[(.*)\]", x)
            return Wording(tuple(words_of(x)), tuple(words_of(core[1] if core else x)))

        self.cue = re.compile(cue_of(templates))
        self.wordings = {k: [wording(x) for x in v] for k, v in templates.items()}
        kind = {"write_content_size": False, "write_checksum": False, "write_dict_id": False, "level": LEVEL}
        self.plain = zstandard.ZstdCompressor(**kind)
        self.with_dict = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(
            "\n".join(" ".join(w.words) for w in v).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **kind)
            for k, v in self.wordings.items()}

    def ranked(self, block: list[str]) -> list[tuple[int, str]]:
        """(bytes saved, template), best first; ties by name."""
        body = " ".join(block).encode()
        plain = len(self.plain.compress(body))
        saved = [(plain - len(c.compress(body)), k) for k, c in self.with_dict.items()]
        return sorted((x for x in saved if x[0] >= LEAST_SAVED), key=lambda x: (-x[0], x[1]))

    def differences(self, name: str, block: list[str]) -> tuple[int, str] | None:
        """(number of differing words, the differences) of the wording of ``name`` nearest to the
        block; None if no core stands in it or too much of the rest differs."""
        best = None
        for w in self.wordings[name]:
            n = len(w.core)
            at = next((i for i in range(len(block) - n + 1) if tuple(block[i:i + n]) == w.core), -1)
            if at < 0:
                continue
            lead = next(i for i in range(len(w.words) - n + 1) if w.words[i:i + n] == w.core)
            lo = max(0, at - lead)
            own = block[lo:at + n + len(w.words) - lead - n]
            changes = [(tag, w.words[a:b], own[c:d]) for tag, a, b, c, d in difflib.SequenceMatcher(
                None, w.words, own, autojunk=False).get_opcodes() if tag != "equal"]
            differ = sum(max(len(a), len(b)) for _, a, b in changes)
            if len(w.words) - n >= LONG_LEAD and differ > MAY_DIFFER * (len(w.words) - n):
                continue
            told = "; ".join(f"{tag} {' '.join(a)} > {' '.join(b)}" for tag, a, b in changes)
            if best is None or (differ, -len(w.words)) < best[0]:
                best = ((differ, -len(w.words)), (differ, told))
        return best[1] if best else None

    def crossing(self, lines: list[list[str]]) -> set[str]:
        """Templates with a core that stands in the lines' words and crosses a line end."""
        line_of = [k for k, own in enumerate(lines) for _ in own]
        block = [w for own in lines for w in own]
        at: dict[str, list[int]] = {}
        for i, w in enumerate(block):
            at.setdefault(w, []).append(i)
        return {name for name, wordings in self.wordings.items() for w in wordings for i in at.get(w.core[0], ())
                if tuple(block[i:i + len(w.core)]) == w.core and line_of[i] != line_of[i + len(w.core) - 1]}

    def confirmed(self, block: list[str], text: str, names: set[str] | None = None) -> list[dict]:
        """The finds in a block, best ranked first (of some templates)."""
        found = []
        for rank, (saved, name) in enumerate(self.ranked(block)):
            got = self.differences(name, block) if names is None or name in names else None
            if got:
                found.append({"license": name, "saved_bytes": saved, "rank": rank + 1, "n_differences": got[0],
                              "differences": got[1], "block": text.strip()})
        return found

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """Number of candidate blocks, and the confirmed finds in order."""
        blocks, found = 0, []
        for sentence in _SENTENCE.split(text):
            if not self.cue.search(sentence):
                continue
            own: list[dict] = []
            for piece in _BLOCK.split(sentence):
                block = words_of(piece) if self.cue.search(piece) else []
                if block:
                    blocks += 1
                    own += self.confirmed(block, piece)
            lines = [words_of(x) for x in sentence.split("\n")]
            over = self.crossing(lines) - {f["license"] for f in own} if len(lines) > 1 else set()
            if over:
                blocks += 1
                own += self.confirmed([w for x in lines for w in x], sentence, over)
            found += own
        return blocks, found


@lru_cache(maxsize=4)
def _scanner(templates: tuple) -> Scanner:
    return Scanner({k: list(v) for k, v in templates})


_FIND = ("license:string,saved_bytes:bigint,rank:bigint,n_differences:bigint,differences:string,block:string")


def license_scan(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None,
                 out: str = "licenses") -> tuple[DataFrame, str]:
    """``docs`` with one more column (its name is returned): struct of n_blocks (candidates) and
    finds (license, saved_bytes, rank, n_differences, differences, block).

    A find says that a wording stands there, also where the sentence denies it ("not licensed under ..."): its
    differences show words put in.  Null and empty texts and texts without a cue have no candidates.  Ties in saved bytes go to
    the first name; repeated rows are scanned alike; all other columns pass through.
    """
    prepare(docs.sparkSession)
    key = tuple((k, tuple(v)) for k, v in (templates or TEMPLATES).items())
    out = free_name(docs, out)
    seen = free_name(docs, "__seen")
    kind = f"struct<n_blocks:bigint,finds:array<struct<{_FIND}>>>"
    arrow = pa.struct([("n_blocks", pa.int64()), ("finds", pa.list_(pa.struct(
        [(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split(":") for x in _FIND.split(","))])))])
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T._parse_datatype_string(kind))])

    def run(batches):
        scanner = _scanner(key)
        for b in batches:
            i = b.schema.get_field_index(seen)
            rows = []
            for t in b.column(i).to_pylist():
                n, finds = scanner.scan(t) if t else (0, [])
                rows.append({"n_blocks": n, "finds": finds})
            yield pa.RecordBatch.from_arrays([*[c for j, c in enumerate(b.columns) if j != i], pa.array(rows, arrow)],
                                             [*[f for j, f in enumerate(b.schema.names) if j != i], out])

    body = F.col(f"`{text}`").cast("string")
    return docs.withColumn(seen, F.when(body.rlike(cue_of(templates or TEMPLATES)), body)).mapInArrow(run, schema), out


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: candidate blocks, confirmed finds, licenses (sorted, joined by commas), and
    the differing words of all finds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the text goes to Python only where it has a cue
    rows, out = license_scan(docs.select("doc_id", F.when(F.col("text").rlike(cue_of(TEMPLATES)), F.col("text")).alias("text")))
    finds = F.col(f"{out}.finds")
    names = F.array_sort(F.array_distinct(F.transform(finds, lambda f: f["license"])))
    return rows.select(
        "doc_id", F.col(f"{out}.n_blocks").alias("n_blocks"), F.size(finds).cast("long").alias("n_finds"),
        F.array_join(names, ",").alias("licenses"),
        F.aggregate(finds, F.lit(0).cast("long"), lambda a, f: a + f["n_differences"]).alias("n_differences"),
        F.sha2(F.array_join(F.transform(finds, lambda f: f["block"]), "\n").cast("binary"), 256).alias("blocks_sha256"))
