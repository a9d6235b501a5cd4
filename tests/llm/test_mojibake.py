from tessera.llm.mojibake import Garbled, misread, multi_forms, single_forms, word_forms

CLEAN = [
    "Der Sachverständige prüfte die Übergabe — „gut“ gemäß § 46.", "Le tribunal supérieur a constaté l’été où l’intéressé déclare.", "El señor pidió 30 € más según la resolución.",
    "A decisão não é clara: à citação, DECISÃO final.", "The tribunal’s “answer” costs £5 — see ¶ 3.", "naïve façade, ﬁnal № 7 договор √ ≤ ∂ 收 👩‍⚖️",
]


def test_forms():
    assert "Ã©" in multi_forms("é") and "ÃƒÂ©" in multi_forms("é") and "├⌐" in multi_forms("é") and "√©" in multi_forms("é")
    assert "depÛsito" in single_forms("depósito") and "depуsito" in single_forms("depósito") and "dep�sito" in single_forms("depósito")
    assert misread(b"\x81", "cp1252") == "\x81" and "â€" in multi_forms("”") and "Ã" not in multi_forms("Í") and "é" not in multi_forms("é")
    assert single_forms("depósito")["depуsito"] == {"cp1252>cp1251", "latin-1>cp1251", "cp1250>cp1251"} and "cp1252>cp1251>cp1252" in word_forms("depósito")["depÑƒsito"]


def test_found_and_restored(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN * 4)]
    garbled = [
        CLEAN[0].encode().decode("latin-1"), CLEAN[1].encode().decode("cp1252", "replace"), CLEAN[2].encode().decode("mac_roman"), CLEAN[3].encode().decode("latin-1").encode().decode("latin-1"),
        "A start. " + CLEAN[4].encode("cp1252").decode("utf-8", "replace"), CLEAN[3].encode("cp1252").decode("cp1251"), CLEAN[1].encode("cp1252").decode("mac_roman"), "x " + "ok " * 20000 + "prÃ¼fte",
    ]
    rows += [(100 + i, t) for i, t in enumerate(garbled)] + [(200, None), (201, ""), (202, "plain ASCII"), (203, garbled[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' as words", "'clash' as id")
    g = Garbled(df)
    assert {r["doc_id"] for r in g.found().collect()} == {*range(100, 108), 203}
    back = {r["doc_id"]: r for r in g.restored().collect()}
    assert back[100]["text"] == back[203]["text"] == CLEAN[0] and back[102]["text"] == CLEAN[2] and back[103]["text"] == CLEAN[3] and back[105]["text"] == CLEAN[3]
    assert back[107]["text"].endswith("ok prüfte") and back[104]["text"].startswith("A start. The tribunal’s")


def test_empty(spark):
    g = Garbled(spark.createDataFrame([], "doc_id bigint, text string"))
    assert g.found().count() == 0 and g.restored().count() == 0


def test_one_accident_marks_no_clean_text(spark):
    clean = ["Die: \xa0Übergabe am Tag.", "SCHÄLSTEDT und SOFT\xadBODEN", "«IRMÃ» e «irmã» ficou", "TREÂNDIAZ a d’été", "VAUPHÊME voilà", "Íñigo ãç ãâ ÃÇ"] * 20
    planted = ["\xa0Übergabe".encode("mac_roman").decode() + " am Tag", "SCHÄLSTEDT".encode("cp1252").decode("mac_roman"), "TREÂNDIAZ a d’été".encode().decode("cp1252"), "VAUPHÊME".encode("cp1252").decode("mac_roman")]
    assert planted[0].startswith("ʆbergabe")
    rows = list(enumerate(clean)) + [(1000 + i, t) for i, t in enumerate(planted)] + [(2000, "û à la fin, Û")]
    g = Garbled(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"] for r in g.found().collect()} == {1000, 1001, 1002, 1003}
    back = {r["doc_id"]: r["text"] for r in g.restored().collect()}
    assert back[1000] == "\xa0Übergabe am Tag" and back[1001] == "SCHÄLSTEDT" and back[1002] == "TREÂNDIAZ a d’été" and back[1003] == "VAUPHÊME"


def test_short_words_follow_the_chain_of_the_sure_ones(spark):
    clean = ["été à la fin", "l’article déjà § 4", "só é não"] * 10
    garbled = "l’article déjà été à § 4".encode("cp1252").decode("mac_roman")
    rows = list(enumerate(clean)) + [(100, garbled + " · à")]
    back = Garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).restored().collect()
    assert [(r["doc_id"], r["text"]) for r in back] == [(100, "l’article déjà été à § 4 · à")]
