import hashlib
import re

from pyspark.sql import functions as F

from assayer.llm import pii, queries

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd = [int(d) for d in digits[::-1][::2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k in pii.BASE_KINDS for m in re.finditer(PATTERNS[k], text or "") if valid(k, m[0])]


TEXTS = [
    None,
    "",
    "a@b.c_d@e.f and x..y@z-1.co.uk. or é@b.c",
    "1.2.3.4.5.6.7.8 12.34.56.256 000255.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 4111 1111 1111 1111-- 4111111111111111",
    "+1 (361) 555-8283, +49 30 901820 +1 +123456789012345678 ++4912345678",
    "ñandú 🙂 mail bob@x.org 🙂 tel. +34 600 100 200 10.0.0.1",
    "a" * 50_000 + "@" + "1 " * 20_000 + "9" * 30_000,
    "a@" + "b." * 20_000 + "c",
    "a@b.c 1.2.3.4 " * 3_000,
    "bob (at) example [dot] com call (361) 555-8283 or 361-555-8283",
]


def test_base_spans_match_brute_force_on_edge_cases(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "q@r.st", "x")] * 2, "doc_id long, text string, spans string")
    got = sorted(((r["doc_id"] is None, r["doc_id"], [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"] if s["base"]]) for r in pii.find(df, ["doc_id"]).collect()), key=str)
    want = sorted([(False, i, brute(t)) for i, t in enumerate(TEXTS)] + [(True, None, [("email", 0, 6)])] * 2, key=str)
    assert got == want


def test_query_matches_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op9_personal_data(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        said = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(b[0] == k for b in base) for k in pii.BASE_KINDS]
        assert set(said) <= set(r["spans"].split(",")) | {""}


def test_the_method_finds_what_base_patterns_do_not(spark):
    rows = {
        1: ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and key: 5', [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]),
        2: ("Pay to IBAN DE89 3704 0044 0532 0130 00 today", [("account", "DE89 3704 0044 0532 0130 00")]),
        3: ("Dear Mrs. Anna Smith, you were born on 03.04.1975.", [("birth", "03.04.1975"), ("name", "Anna Smith")]),
        4: ("She lives at 12 Baker Street and he in the Lindenstraße 5", [("address", "12 Baker Street"), ("address", "Lindenstraße 5")]),
        5: ("My account number is 20394857 there", [("account", "20394857")]),
        6: ("In 20394857 cases of 03.04.1975, nothing; the Street was long, and Baker too. A key to it.", []),
        7: ("Pay to IBAN DE89 3704 0044 0532 0130 01 or XY12ABCD EFGH", []),
        8: ("ssn 078-05-1120 ok", [("account", "078-05-1120")]),
    }
    many = spark.createDataFrame([(100 * copy + i, t) for copy in range(8) for i, (t, _) in rows.items()], "doc_id long, text string")
    for r in pii.find(many, ["doc_id", "text"]).collect():
        found = [(pii.KINDS[s["kind"]], r["text"][s["start"] : s["end"]]) for s in r["spans"] if not s["base"]]
        if r["doc_id"] % 100 != 7:
            assert found == rows[r["doc_id"] % 100][1], r["text"]
        assert not [s for s in r["spans"] if s["base"]]


def test_checksum_of_account_numbers(spark):
    df = spark.createDataFrame([("DE89 3704 0044 0532 0130 00",), ("GB29 NWBK 6016 1331 9268 19",), ("FR1420041010050500013M02606",), ("DE89 3704 0044 0532 0130 01",)], "x string")
    assert [r[0] for r in df.select(pii._remainder_97(F.col("x")) == 1).collect()] == [True, True, True, False]


def test_queries_found_more_than_the_base(spark):
    rows = queries.op9_personal_data(spark, "/root/testdata/sf0.1").collect()
    assert sum(r["spans"].count("secret:") for r in rows) > 50


def test_mask_keeps_rows_columns_and_clean_text(spark):
    df = spark.createDataFrame([(1, "mail bob@x.org or +1 (361) 555-8283!", 3), (2, "clean", 4), (3, None, 5)], "doc_id long, text string, n_chars long")
    df = df.unionByName(spark.createDataFrame([(4, "é a@b.c 🙂" * 1000, 6), (5, "x@1.2.3.4.de +1 (361) 555-8283", 7)], df.schema))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.mask(df).collect()}
    assert got == {1: ("mail <EMAIL> or <PHONE>!", 3), 2: ("clean", 4), 3: (None, 5), 4: ("é <EMAIL> 🙂" * 1000, 6), 5: ("<EMAIL> <PHONE>", 7)}
    assert pii.mask(df).columns == df.columns
    clash = df.withColumnRenamed("n_chars", "__spans").withColumn("spans", F.col("doc_id"))
    assert {(r["doc_id"], r["text"], r["__spans"], r["spans"]) for r in pii.mask(clash).collect()} == {(k, t, n, k) for k, (t, n) in got.items()}
    long = "x@y.zz " * 40_000
    (one,) = pii.mask(spark.createDataFrame([(long,)], "text string")).collect()
    assert one["text"] == "<EMAIL> " * 40_000
    assert pii.mask(df.limit(0)).count() == 0


def test_reliable_labelers_outvote_a_noisy_one():
    counts = {("+++-", 1): 5, ("++++", 1): 400, ("---+", 1): 300, ("----", 1): 300, ("++0+", 1): 200}
    p = pii.train(counts, pii.reliabilities(counts))
    assert p["++++", 1] > 0.9 > 0.5 > p["----", 1] and p["++0+", 1] > 0.5 > p["---+", 1]
