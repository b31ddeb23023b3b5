"""Licence scan: whole texts in every wrapping, digests of long licences, texts given as a table."""

import os
import textwrap

import pytest
from nearfield.llm import licences
from pyspark.sql import functions as F

TEXTS = dict(reversed(licences.KNOWN))  # the first text of each licence
DEBIAN = "/usr/share/common-licenses"


def found(spark, docs, **options):
    return {(r["doc_id"], r["licence"], r["whole"]) for r in licences.scan(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()}


def test_short_notices(spark):
    docs = [(1, "Copyright (c) 2020 X\nReleased under the MIT LICENCE"), (2, "released under mit"), (3, "x\nLicensed under the Apache License,  Version 2.0!\ny")]
    assert found(spark, docs) == {(1, "MIT", True), (3, "Apache-2.0", False)}


@pytest.mark.parametrize("licence, text", [(a, b) for a, b in licences.KNOWN if "\n\n" in b])
def test_whole_texts_however_they_are_wrapped(spark, licence, text):
    blocks = text.split("\n\n")
    wrapped = ["\n\n".join("\n".join(textwrap.wrap(b, n)) for b in blocks) for n in (40, 61, 78)]
    header = "/*\n" + "\n".join(f" * {line}".rstrip() for line in wrapped[2].split("\n")) + "\n */"
    spelled = wrapped[1].replace("acknowledgment", "acknowledgement").upper().replace(" LICENSE", " licence")
    inside = f"Some project\n\n{wrapped[0]}\n\nint main() {{ return 0; }}"
    head = f"Copyright (c) 2019, 2021 Somebody <a@b.c>\nAll rights reserved.\n\n{wrapped[1]}"
    docs = list(enumerate([*wrapped, header, spelled, head, f"#!/bin/sh\n\n{header}\n\nexit", inside, text.replace("\n\n", "\n")]))
    got = {(d, whole) for d, name, whole in found(spark, docs) if name == licence}
    assert {d for d, whole in got if whole} >= {0, 1, 2, 3, 4, 5} and {d for d, _ in got} >= set(range(8))


def test_lines_that_begin_with_copyright_stay(spark):
    rows = spark.createDataFrame([(0, "THE AUTHORS OR\nCOPYRIGHT HOLDERS BE LIABLE"), (1, "THE AUTHORS\nOR COPYRIGHT HOLDERS BE LIABLE"), (2, "Copyright 2020 X\nwords"), (3, "copyright notice and\nwords"), (4, "the colour file"), (5, "the color file")], "n int, text string")
    got = {r["n"]: r["c"] for r in rows.select("n", licences.one_line(licences.canonical(F.col("text"))).alias("c")).collect()}
    assert got[0] == got[1] == "the authors or copyright holders be liable" and got[2] == "words" and got[3] == "copyright notice and words" and got[4] == got[5]


@pytest.mark.skipif(not os.path.isdir(DEBIAN), reason="no licence texts here")
def test_digests_are_those_of_whole_licences(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    docs = []
    for i, name in enumerate(names):
        with open(f"{DEBIAN}/{name}", encoding="utf-8") as file:
            text = file.read()
        docs += [(2 * i, text), (2 * i + 1, f"Before.\n\n{text}\n\nAfter.")]
    got = found(spark, docs)
    for i, licence in enumerate(names.values()):
        assert {(2 * i, licence, True), (2 * i + 1, licence, False)} <= got


def test_texts_given_as_a_table(spark, tmp_path, monkeypatch):
    for name, text in (("Own-1.0.txt", "You may do as you like.\n\nBut ask first."), ("Own-2.0.txt", "You may not.")):
        (tmp_path / name).write_text(text)
    texts = licences.read_texts(spark, str(tmp_path))
    docs = [(1, "x\n\nYou may do as\nyou like\n\nBut ask first\n\ny"), (2, "you may NOT"), (3, "Released under the MIT License.")]
    want = {(1, "Own-1.0", False), (2, "Own-2.0", True)}
    assert found(spark, docs, texts=texts) == want
    monkeypatch.setattr(licences, "BROADCAST_ROWS", 1)
    assert found(spark, docs, texts=texts) == want


def test_nothing_known(spark):
    texts = spark.createDataFrame([], "licence string, text string")
    assert found(spark, [(1, "Released under the MIT License."), (2, None), (3, "")], texts=texts) == set()
