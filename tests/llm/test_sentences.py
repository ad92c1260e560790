import pytest
from pyspark.sql import functions as F

from pageloom.llm.sentences import ends_column, sentence_ends, sentence_units

CASES = [
    ("It stops. It starts.", ["It stops.", "It starts."]),
    ("Dr. Low and Mrs. High met at 5 p.m. They left.", ["Dr. Low and Mrs. High met at 5 p.m.", "They left."]),
    ("See Fig. 8 and Vol. 81, cf. the note on p. 17. Version 6.1.5 ships.", ["See Fig. 8 and Vol. 81, cf. the note on p. 17.", "Version 6.1.5 ships."]),
    ("J. R. Low wrote it. The U.S. edition is old.", ["J. R. Low wrote it.", "The U.S. edition is old."]),
    ("“Is it green?” asked the clerk. He left.", ["“Is it green?” asked the clerk.", "He left."]),
    ("She said: “Wait. Do not touch it.” The pump ran.", ["She said: “Wait. Do not touch it.”", "The pump ran."]),
    ("(Section 4.2 still applies.) The rest is void.", ["(Section 4.2 still applies.)", "The rest is void."]),
    ("Reset it now... The clerk may wait. It shows ... and goes blank.", ["Reset it now...", "The clerk may wait.", "It shows ... and goes blank."]),
    ("Did it stop?! Yes! eKey 5 opens it.", ["Did it stop?!", "Yes!", "eKey 5 opens it."]),
    ("Storage\n\nThe pump is\nin the cellar. It runs", ["Storage", "The pump is\nin the cellar.", "It runs"]),
    ("Take these steps:\n• check it\n• sign it;\n\nThen leave.", ["Take these steps:", "• check it", "• sign it;", "Then leave."]),
    ("Do this:\n1. check it.\n2. sign it", ["Do this:", "1. check it.", "2. sign it"]),
    ("Do this:\n1. open it:\n- turn the key\n- push\n2. sign it\n3. leave", ["Do this:", "1. open it:", "- turn the key", "- push", "2. sign it", "3. leave"]),
    ("1) first:\na) one\nb) two\n2) second", ["1) first:", "a) one", "b) two", "2) second"]),
    ("The note is on page\n12. It is short.", ["The note is on page\n12.", "It is short."]),
    ("Der Wert liegt bei 3,5 bzw. 4 Euro. Am 3. Mai war er z. B. höher.", ["Der Wert liegt bei 3,5 bzw. 4 Euro.", "Am 3. Mai war er z. B. höher."]),
    ("„Ist es aus?“ fragte er. Ja.", ["„Ist es aus?“ fragte er.", "Ja."]),
    ("¿Está apagado? ¡No abra! La Sra. Low firmó.", ["¿Está apagado?", "¡No abra!", "La Sra. Low firmó."]),
    ("« Où est la clé ? » a demandé l’agent. Voir p. ex. art. 3. Fin.", ["« Où est la clé ? » a demandé l’agent.", "Voir p. ex. art. 3.", "Fin."]),
    ("См. рис. 5 и стр. 65. Журнал закрыт.", ["См. рис. 5 и стр. 65.", "Журнал закрыт."]),
    ("传感器关闭。标签写着“小心！”他走了。完", ["传感器关闭。", "标签写着“小心！”他走了。", "完"]),
    ("ラベルには「開けるな！」とある。誰だ？", ["ラベルには「開けるな！」とある。", "誰だ？"]),
    ("पंप बंद है। क्या यह बंद है? हाँ।", ["पंप बंद है।", "क्या यह बंद है?", "हाँ।"]),
    ("المضخة مغلقة. أ. Low وقع على AB12. انتهى", ["المضخة مغلقة.", "أ. Low وقع على AB12.", "انتهى"]),
    ("من فتح الوحدة؟ السجل مغلق.", ["من فتح الوحدة؟", "السجل مغلق."]),
    ("เครื่องปิด ทีมเปิดหน่วย AB12 เสมอ จบ", ["เครื่องปิด", "ทีมเปิดหน่วย AB12 เสมอ", "จบ"]),
]


@pytest.mark.parametrize("text,units", CASES)
def test_units(text, units):
    ends = sentence_ends(text)
    starts = [0, *ends[:-1]]
    assert [text[a:b].strip() for a, b in zip(starts, ends)] == units


def test_invariants_over_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/page_data.parquet")
    for row in pages.select("text", ends_column(F.col("text")).alias("ends")).collect():
        if not (row.text or "").strip():
            assert row.ends == []
            continue
        assert row.ends == sorted(set(row.ends)) and row.ends[-1] == len(row.text.rstrip())
        cuts = [0, *row.ends]
        assert all(row.text[a:b].strip() for a, b in zip(cuts, cuts[1:]))


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 5), (1, "A b. C d.", 5), (2, None, 5), (3, " \n", 5), (None, "X", 5)], "row_id long, text string, ends int")
    rows = sorted((str(r.row_id), r.start_char, r.end_char, r.unit) for r in sentence_units(df, "row_id", "text", with_text=True).collect())
    assert rows == [("1", 0, 4, "A b."), ("1", 0, 4, "A b."), ("1", 4, 9, "C d."), ("1", 4, 9, "C d."), ("None", 0, 1, "X")]
    assert sentence_units(df.limit(0), "row_id", "text").count() == 0
