import re

import numpy as np
import pytest

from samewise.llm import licences
from samewise.llm.queries import QUERIES
from tests.llm.fixtures import documents, texts, write_tables


@pytest.fixture(scope="module")
def model():
    return licences.standard()


def families(spark, model, texts):
    df = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    return {r["doc_id"]: r for r in licences.summary(licences.licences(df, model)).collect()}


def brute(model, text, least_probability=licences.LEAST, least_shared=0.5):
    """(start, end, family) of the notices, judging every block and every line."""
    text, found, at = text or "", [], 0
    marks = r"[ \t\n\x0b\f\r*#/;%<>!-]+"
    for block in re.split(r"(\n[\x20\t\r]*\n\s*)", text, flags=re.ASCII):
        units = [(at, block)] if not re.fullmatch(r"\n[\x20\t\r]*\n\s*", block, flags=re.ASCII) else []
        if units and "\n" in block:
            units += [(at + m.start(), m[0]) for m in re.finditer(r"[^\n]+", block)]
        at += len(block)
        got = []
        for start, u in units:
            family, p = model.judged(u)
            if family != "unknown" and p >= least_probability and licences.shared(u, family) >= least_shared:
                lead = re.match(marks, u)
                got.append((start + (lead.end() if lead else 0), start + len(re.sub(r"[ \t\n\x0b\f\r]+\Z", "", u)), family))
                if len(got) == 1 and u is block:
                    break
        found += got
    merged = []
    for start, end, family in found:
        if merged:
            a, b, last = merged[-1]
            kin = last == family or last.startswith(family + "-") or family.startswith(last + "-")
            if kin and re.fullmatch(r"[\s*#/;%<>!-]*", text[b:start], flags=re.ASCII):
                merged[-1] = (a, end, max(family, last, key=lambda f: (len(f), f == last)))
                continue
        merged.append((start, end, family))
    return merged


HARD = {
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n",
    "gpl-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n",
    "epl-2.0": "It was released to the public under the Eclipse Public License v2.0",
    "apache-2.0 or mit": "Dual licensed: Apache-2.0 OR MIT",
    "mit": "MIT License\n\nCopyright (c) 2019 Jo Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
}


def test_op9_notices_as_they_are_found(spark, model):
    got = families(spark, model, [*HARD.values(), "Use is under GPLv3", "MIT", "Licensed under the Artistic License 2.0", "SPDX-License-Identifier: Zlib", "We like GPL-free paint."])
    assert [got[i]["families"] for i in range(len(got))] == [*HARD, "gpl-3.0", "", "", "", ""]
    assert [got[i]["n_licences"] for i in range(5)] == [1, 1, 1, 1, 2]


def test_op9_against_brute_force(spark, model):
    own = [t for t, _, _ in licences.labelled(copies=3, seed=77)]
    some = [t for t in texts() if t is None or len(t) < 5000]
    some += own + ["\n".join(own[i : i + 3]) for i in range(0, 60, 3)] + ["some line\n" + " \n\n  // ".join(own[i : i + 4]) + "\nend\n" for i in range(0, 80, 4)] + [t + "\n\nand more. " + some[k % 30] for k, t in enumerate(HARD.values())]
    got = families(spark, model, some)
    for i, t in enumerate(some):
        assert got[i]["spans"] == ",".join(f"{f}:{a}:{b}" for a, b, f in brute(model, t)), t


def test_op9_other_variations_than_the_fit_saw(spark, model):
    own = licences.labelled(copies=8, seed=77)
    got = families(spark, model, [t for t, _, _ in own])
    right = [got[i]["families"] == ("" if f == "unknown" else f) for i, (_, f, _) in enumerate(own)]
    assert sum(right) / len(right) > 0.93
    assert all(got[i]["families"] == "" for i, (_, f, _) in enumerate(own) if f == "unknown")


def test_op9_places_and_ordinary_text(spark, model):
    some = [
        "é ü\nReleased under the MIT License.\nnothing\nLicensed under CC BY-NC 4.0.", "The MIT campus has a licensed cafe.", "license " * 3000, "x" * 50_000, None, "",
        "a line\r\nLicensed under the Apache License, Version 2.0.", "this work is LICENSED under the gnu general public license, version 3. " * 2, "some words about driving\n" * 500 + "Released under the MIT License.",
    ]
    got = families(spark, model, some)
    assert got[0]["spans"] == "mit:4:35,cc-by-nc-4.0:44:72" and got[0]["families"] == "cc-by-nc-4.0,mit"
    assert [got[i]["n_licences"] for i in (1, 2, 3, 4, 5)] == [0] * 5
    assert got[6]["families"] == "apache-2.0" and got[7]["families"] == "gpl-3.0"
    assert got[8]["spans"] == f"mit:{500 * 25}:{500 * 25 + 31}"


def test_op9_query(spark, tmp_path):
    docs = documents(spark)
    df = QUERIES["op9_licences"](spark, write_tables(spark, tmp_path, documents=docs))
    assert not re.search("Python|Pandas|Arrow|Exchange", df._jdf.queryExecution().executedPlan().toString())
    assert df.count() == docs.count()
    assert QUERIES["op9_licences"](spark, write_tables(spark, tmp_path / "none", documents=docs.where("1 = 0"))).count() == 0


def test_op9_unknown_is_calibrated_on_templates_the_fit_did_not_see(model):
    own = licences.labelled(copies=4, seed=1)
    sure, right = [], []
    for k in range(3):
        part = licences.fit([x for x in own if x[2] % 3 != k])
        for t, f, n in own:
            if n % 3 == k:
                family, p = part.judged(t)
                sure.append(p)
                right.append(family == f)
    assert abs(np.mean(sure) - np.mean(right)) < 0.1
    assert len(model.weights) < len({g for t, _, _ in licences.labelled() for g in licences.grams(t)})
