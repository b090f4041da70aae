import pytest

from tidemill.llm import licences

NOTICES = {
    "Released under the MIT License.": ["MIT"],
    "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
    "This work is licensed under the GNU General Public License, version 3.": ["GPL"],
    "Licensed under CC BY-NC 4.0.": ["CC-BY-NC"],
    "licensed  under the apache license version 2.0\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software": ["Apache-2.0", "MIT"],
    "The driver's license was released to the public under version 3.": [],
    "All rights reserved by the publisher.": [],
    "Licensed under the Acme License, version 9.": [],
}


@pytest.fixture(scope="module")
def model(docs):
    return licences.train(docs)


def families(df):
    return {r["text"]: sorted({n["family"] for n in r["notices"]}) for r in df.collect()}


def test_notices_in_and_out_of_prose(spark, model, rows):
    prose = [r[1] for r in rows if r[1] and len(r[1]) > 200][:8]
    texts = [*NOTICES, *(f"{p}\n{n}\n{p}" for p, n in zip(prose, NOTICES))]
    found = families(licences.scan(spark.createDataFrame([(t,) for t in texts], "text string"), model))
    assert {t: found[t] for t in NOTICES} == NOTICES
    for p, n in zip(prose, NOTICES):
        assert found[f"{p}\n{n}\n{p}"] == NOTICES[n]


def test_a_notice_inside_a_long_line_is_found_with_its_place(spark, model, rows):
    p = rows[5][1].replace("\n", " ")
    text = f"{p} Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License {p}"
    notices = licences.scan(spark.createDataFrame([(text,)], "text string"), model).first()["notices"]
    assert {n["family"] for n in notices} == {"Apache-2.0"}
    assert any("Apache" in text.encode()[n["start"] : n["end"]].decode(errors="ignore") for n in notices)


def test_plain_texts_have_none(docs, no_docs, model, rows):
    out = licences.scan(docs, model).collect()
    assert len(out) == len(rows) and not any(r["notices"] for r in out)
    assert licences.scan(no_docs, model).count() == 0
    assert licences.scan(docs.withColumnRenamed("lang", "notices"), model).count() == len(rows)
    assert licences.train(no_docs).temperature > 0


def test_probabilities_are_calibrated_on_held_variations(model):
    assert 0.2 < model.temperature < 8.1
