"""Native operators equal their DuckDB twins, on odd texts and on the supplied documents."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from compare import rows_of  # noqa: E402
from conftest import SF001  # noqa: E402
from tidemark.llm import licenses, quality  # noqa: E402
from tidemark.llm.common import documents  # noqa: E402
from tidemark.llm.oracles import ORACLES  # noqa: E402

OPERATORS = {"op3_quality_rules": quality.quality, "op6_license_scan": licenses.license_scan}
#: All notices, whole.
NOTICES = [wording for _, wording, _ in licenses.TEMPLATES]
TEXTS = ["", " ", None, "\n\n", "one two three four five six seven eight nine ten", "a b c d e f a b c d e f a b c d e x y z",
         "HELLO WORLD THIS IS LOUD AND LONG ENOUGH\nplain line of words here to keep the text\nclick here\nHome | About | Contact",
         "yes!! no?? so## it** is%% all&& bad<< and>> ends\na b\na b\na  b", "Licensed under the Apache License, Version 2.0. MIT License; cc by 4.0",
         "gnu General Public LICENSE cc by cc by", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
         "%s\nLicensed under CC BY-NC 4.0.\n%s" % (NOTICES[7], NOTICES[5]), " and ".join(NOTICES), " ".join(reversed(NOTICES)), "\n".join(NOTICES) * 3,
         *("x y " + n + " z" for n in NOTICES), *(" ".join(w for i, w in enumerate(n.split()) if i % 4 != 1) for n in NOTICES),
         "Released under the MIT license. " * 40, "ÉCOLE ÜBER ÄÖÜ ß 日本語 » › • ·", "word " * 3000, "x" * 5000]


@pytest.fixture(scope="module", params=["odd", "supplied", "empty"])
def table(request, spark, tmp_path_factory):
    if request.param == "supplied":
        return documents(spark, SF001), f"{SF001}/documents.parquet"
    path = str(tmp_path_factory.mktemp("twins") / request.param)
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(3, TEXTS[5], "en"), (3, TEXTS[5], "en"), (None, TEXTS[8], None)]
    spark.createDataFrame(rows if request.param == "odd" else [], "doc_id long, text string, labels string").write.parquet(path)
    return spark.read.parquet(path), f"{path}/*.parquet"


@pytest.mark.parametrize("key", OPERATORS)
def test_operator_equals_twin(table, key):
    docs, files = table
    df = OPERATORS[key](docs)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{files}')")
        cur = con.execute(ORACLES[key])
        columns, rows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()], 9) == rows_of(columns, rows, 9)
