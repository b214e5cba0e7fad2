import hashlib
import re

import duckdb

from webweft.llm import secrets as S

BASE = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                              re.I | re.A), 2, 12),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile(r"[0-9a-f]+"), 0, 16)}
KEY = "AKIA" + "A1B2C3D4E5F6G7H8"
BLOB = "aB3" * 9

TEXTS = {
    1: None, 2: "", 3: "nothing here", 4: 'token = "abcdefghijkl" and password: short',
    5: f"é𝄞 {KEY} then 0123456789abcdef0 x", 6: "password=token=abc tokens api-key api_key='0123456789abcdef'",
    7: f"user: bob {BLOB}", 8: BLOB + " alone", 9: "user: bob alone", 10: f"{KEY} " + "x " * 98 + f" {BLOB}",
    11: f"{KEY} " + "x " * 400 + f" {BLOB}", 12: f"db.example.com:5432 and {KEY}", 13: "https://example.com/a alone",
    14: "a\x01b token=abcdefghijkl\x01mnop", 15: "passwd : AAAA\npasswd : BBBBBBBBBBBBB", 16: "deadbeef" * 4000,
    17: "ToKeN:=x/y+z_1.2-3=4=", 18: "AKIAAKIA1 AKIA" + "Z" * 13 + " AKIA" + "Z" * 14,
    19: ("secret=abcdefghijklm " * 3000), 20: "a" * 60000 + ".b:" + "." * 3000, 21: "word " * 40 + "SECRET='AB/CD+EF=GH12'",
}


def base_spans(text):
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def table(spark, tmp_path, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return {r.doc_id: r for r in S.op8_secrets(spark, str(tmp_path)).collect()}


def test_base_spans_equal_python_regexes(spark, tmp_path):
    got = table(spark, tmp_path, list(TEXTS.items()))
    assert got.keys() == TEXTS.keys()
    for d, text in TEXTS.items():
        want = base_spans(text)
        assert got[d].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), d
        assert [x for x in got[d].spans.split(",") if x.split(":")[0] in BASE] == want, d
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(
            sum(x.startswith(k) for x in want) for k in BASE), d


def test_weak_parts_need_a_complement_in_scope(spark, tmp_path):
    got = table(spark, tmp_path, list(TEXTS.items()))
    weak = {d: sorted(x.split(":")[0] for x in r.spans.split(",") if x and x.split(":")[0] not in BASE)
            for d, r in got.items()}
    assert weak[7] == ["blob", "ident"] and weak[8] == [] and weak[9] == []
    assert weak[10] == ["blob"] and weak[11] == [] and weak[12] == ["endpoint"] and weak[13] == []


def test_oracle_sql_on_odd_texts(spark, tmp_path):
    got = table(spark, tmp_path, list(TEXTS.items()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rel = con.sql(S.SQL["op8_secrets"])
    rows = {r[0]: dict(zip(rel.columns, r)) for r in rel.fetchall()}
    assert {d: r.asDict() for d, r in got.items()} == rows


def test_repeated_rows_null_ids_and_clashing_columns(spark, tmp_path):
    rows = [(1, "token=abcdefghijkl", 5), (1, "token=abcdefghijkl", 6), (None, f"{KEY}", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, spans int").write.parquet(str(tmp_path / "documents.parquet"))
    out = sorted((str(r.doc_id), r.n_assign, r.n_access) for r in S.op8_secrets(spark, str(tmp_path)).collect())
    assert out == [("1", 1, 0), ("1", 1, 0), ("None", 0, 1)]


def test_empty_table(spark, tmp_path):
    assert table(spark, tmp_path, []) == {}


def test_main_path_has_no_python(spark, tmp_path):
    table(spark, tmp_path, [(1, "x")])
    plan = S.op8_secrets(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_stage_redacts_every_reported_span(spark):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in TEXTS.items()],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in S.redact(spark, docs, "").collect()}
    assert out.keys() == TEXTS.keys() and out[1].text is None
    assert out[4].text == '<SECRET>" and password: short' and out[3].text == TEXTS[3]
    assert out[5].text == "é𝄞 <SECRET> then <SECRET> x" and out[8].text == TEXTS[8]
    assert out[7].text == "<SECRET> <SECRET>" and out[19].text == "<SECRET> " * 3000
    assert all(r.n_chars == len(r.text or "") for r in out.values())
    for r in out.values():
        assert not base_spans(r.text)


def test_a_lone_token_does_not_complement_itself(spark, tmp_path):
    value = "Ab12Cd34Ef56Gh78Ij90"
    lone = {1: f"client_id={value}", 2: f"account: {value} alone", 3: f"access_key_id={KEY}", 4: f"user={value}"}
    both = {5: f"client_id={value} and {BLOB}", 6: f"user: bob client_id={value}"}
    got = table(spark, tmp_path, list((lone | both).items()))
    assert [got[d].spans for d in (1, 2, 4)] == ["", "", ""] and got[3].spans == "access:14:34"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rel = con.sql(S.SQL["op8_secrets"])
    assert {r[0]: dict(zip(rel.columns, r)) for r in rel.fetchall()} == {d: r.asDict() for d, r in got.items()}
    assert got[5].spans == "ident:0:30,blob:35:62" and got[6].spans == "ident:0:9,blob:10:40"
    docs = spark.createDataFrame(list(lone.items()), "doc_id long, text string")
    out = {r.doc_id: r.text for r in S.redact(spark, docs, "").collect()}
    assert out == lone | {3: "access_key_id=<SECRET>"}


def test_stage_keeps_columns_with_the_names_it_uses(spark):
    docs = spark.createDataFrame([(1, "token=abcdefghijkl", 5, "a", 6)], "doc_id long, text string, cuts int, _doc_at string, Cuts_ int")
    out = S.redact(spark, docs, "")
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "<SECRET>", 5, "a", 6)]
