"""Licence lines however common they are."""

import pytest

from lodestone.llm import license_scan
from tests.llm.test_text_operators import prose

APACHE = "Licensed under the Apache License, Version 2.0."


@pytest.mark.parametrize("n,common", [(100, 34), (100, 100), (3, 1), (1, 1)])
def test_common_lines_are_found(spark, n, common):
    rows = [(i, prose(40) + (f"\n{APACHE}\n{prose(10)}" if i < common else "")) for i in range(n)]
    found = license_scan.own_licenses(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()
    assert [r["own"]["license"] for r in sorted(found)] == ["Apache-2.0"] * common + [None] * (n - common)
    assert all(r["own"]["score"] > 0.999 for r in found if r["doc_id"] < common)


def test_everyday_words_tell_nothing(spark):
    rows = [(i, t) for i, t in enumerate(["the License", "version 2.0", "this program is free software", "under the terms of the", "import os\n2.0\n3"])]
    found = license_scan.own_licenses(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()
    assert all(r["own"]["license"] is None for r in found)


@pytest.mark.parametrize("name", sorted(license_scan.full_texts()))
def test_license_files_rule_their_directory(spark, name):
    body = license_scan.full_texts()[name]
    body = "\n".join(["Copyright (c) 2024 Somebody Else", *body.split("\n")])
    rows = [(f"{name}/LICENSE", body), (f"{name}/src/x.py", prose(30)), ("other/y.py", prose(30)), *((f"z/{i}.txt", prose(200)) for i in range(20))]
    files = license_scan.own_licenses(spark.createDataFrame(rows, "path string, text string"), "text")
    found = {r["path"]: r for r in license_scan.inherit(files, "path").collect()}
    assert found[f"{name}/LICENSE"]["license"] == name and found[f"{name}/LICENSE"]["own"]["share"] == 1
    assert (found[f"{name}/src/x.py"]["license"], found[f"{name}/src/x.py"]["inherited_from"]) == (name, name)
    assert found["other/y.py"]["license"] is None


def test_wrapped_statements_and_notices(spark):
    bsd = "Copyright (c) 2020 X. All rights reserved.\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted. Licensed under the BSD 3-Clause License."
    wrapped = "# Licensed under the Apache License, Version 2.0 (the License);\n# you may not use this file except in compliance\n# with the License."
    rows = [(0, prose(200) + "\n" + bsd), (1, prose(200) + "\n" + wrapped + "\n" + prose(9)), (2, prose(20) + "\nCopyright. All rights reserved."), *((i, prose(50)) for i in range(3, 30))]
    found = license_scan.own_licenses(spark.createDataFrame(rows, "doc_id long, text string"), "text").orderBy("doc_id").collect()
    assert [r["own"]["license"] for r in found[:4]] == ["BSD-3-Clause", "Apache-2.0", "Proprietary", None]
    assert found[1]["own"]["score"] > 0.99


def test_prose_is_no_license_text():
    import pydoc_data.topics

    texts = [t.encode() for t in pydoc_data.topics.topics.values()]
    matcher = license_scan.Matcher(license_scan.telling(license_scan.full_texts()), {}, len(texts))
    lines = license_scan.Matcher(license_scan.TEMPLATES, {}, len(texts))
    assert all((lines.scan(t, 0.6, matcher)[2] or 0) < 1 for t in texts)
