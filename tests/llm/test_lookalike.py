from pyspark.sql import functions as F

from pageloom.llm.lookalike import build_classes, consistent_form, count_code_points, fit, lookalike_classes, lookalike_members, lookalike_pairs

PLAIN = "Naïve café, first Office 8°C at the U.S. site – no. 5."
VARIANTS = [
    "Naïve café, first Office 8°C at the U.S. site – no. 5.",
    "Naïve café, first　Office 8°C at the U.S. site – no. 5.",
    "Na​ïve c­afé, fi⁠rst Office 8°C at the U.S. site – no. 5.",
    "Naïve café, ﬁrst Oﬃce 8℃ at the U.S. site – no. 5.",
    "Nаïvе саfé, fіrѕt Оffiсе 8°С аt thе U.S. ѕіtе – nο. 5.",
    "Naïve café, ｆｉｒｓｔ Office ８°Ｃ at the U.S. site – no. 5.",
]
OTHERS = ["Naive café, first Office 8°C at the U.S. site – no. 5.", PLAIN.lower(), PLAIN.replace("–", "-"), PLAIN.replace("8", "6"), PLAIN.replace("first", "f1rst")]


def test_forms_agree_exactly_where_texts_look_the_same(spark):
    texts = [PLAIN, *VARIANTS, *OTHERS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    forms = {r.id: r.form for r in df.select("id", consistent_form(F.col("text"), fit(df.select("text"))).alias("form")).collect()}
    assert len({forms[i] for i in range(1 + len(VARIANTS))}) == 1
    assert len({*forms.values()}) == 1 + len(OTHERS)


def test_representatives_follow_frequency_and_are_stable():
    for favoured in ({"а": 9, "a": 1, "ό": 5, "ó": 1}, {"а": 1, "a": 9, "ό": 1, "ó": 5}):
        rewrite = build_classes(favoured | {"о": 3, "́": 2, "​": 1}).rewriter()
        assert rewrite("а") == rewrite("a") == max(("а", "a"), key=favoured.get)
        assert rewrite("ό") == rewrite("ó") == rewrite("о́") == rewrite("ο​́")
        assert rewrite(rewrite("ό а")) == rewrite("ό а")


def test_hyphens_and_half_width_kana():
    rewrite = build_classes(dict.fromkeys("‐‑-–ｶﾞガカ゛ﾞ", 1)).rewriter()
    assert rewrite("A‐1") == rewrite("A‑1") == rewrite("A-1") != rewrite("A–1")
    assert rewrite("ｶﾞ") == rewrite("ガ")


def test_pairs_against_brute_force_with_nulls_copies_and_extra_columns(spark):
    texts = [PLAIN, PLAIN, *VARIANTS, *OTHERS, None, "", " 　", "​"]
    rows = [("a" if i % 3 else "b", i, t, "x", "y") for i, t in enumerate(texts)] + [("a", None, PLAIN, "x", "y"), ("a", 4, VARIANTS[2], "x", "y")]
    df = spark.createDataFrame(rows, "table_name string, row_id long, text string, form string, looks string")
    classes = fit(df.select("text"))
    rewrite = classes.rewriter()
    found = sorted(tuple(r) for r in lookalike_pairs(lookalike_members(df, ["table_name"], "row_id", "text", classes), ["table_name"]).collect())
    want = {
        (g, min(i, j), max(i, j))
        for g, i, t, *_ in rows
        for h, j, u, *_ in rows
        if g == h and i is not None and j is not None and i != j and t and u and t != u and rewrite(t) and rewrite(t) == rewrite(u)
    }
    assert found == sorted(want)


def test_classes_count_their_rows_and_strings(spark):
    rows = [(i, t) for i, t in enumerate([PLAIN, PLAIN, VARIANTS[3], OTHERS[0], None, " "])]
    df = spark.createDataFrame(rows, "row_id long, text string")
    out = {r.id: r for r in lookalike_classes(lookalike_members(df, [], "row_id", "text", fit(df.select("text"))), []).collect()}
    assert {i: (r.rows, r.strings) for i, r in out.items()} == {0: (3, 2), 1: (3, 2), 2: (3, 2), 3: (1, 1)}
    assert len({out[i]["class"] for i in range(3)}) == 1 and out[3]["class"] != out[0]["class"]


def test_strings_and_code_points_share_classes():
    rewrite = build_classes(dict.fromkeys("ﬃﬁfi℃°CС…. ㎞km​é", 1)).rewriter()
    for a, b in (("ﬃ", "ffi"), ("℃", "°C"), ("°С", "℃"), ("…", "..."), ("é", "é"), ("k​m", "km")):
        assert rewrite(a) == rewrite(b)


def test_empty_table(spark):
    df = spark.createDataFrame([], "table_name string, row_id long, text string")
    classes = fit(df.select("text"))
    assert count_code_points(df.select("text")).count() == 0
    members = lookalike_members(df, ["table_name"], "row_id", "text", classes)
    assert lookalike_pairs(members, ["table_name"]).count() == 0 and lookalike_classes(members, ["table_name"]).count() == 0
