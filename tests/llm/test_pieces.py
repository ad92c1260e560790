import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm.pieces import measured, oversized_rows, pieces_column, split_rows, split_text


def check(text, limit, overlap):
    pieces, whole = split_text(text, limit, overlap), measured(text)[0]
    assert all(len(x) <= limit for x in pieces)
    if len(whole) <= limit:
        assert pieces == ([whole] if whole else [])
        return
    assert len(pieces) > 1
    end = None
    for piece in pieces:
        at = whole.find(piece, 0 if end is None else max(0, end - overlap))
        assert at >= 0 and (end is None or end - overlap <= at <= end + 1)
        end = at + len(piece)
    assert end == len(whole)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n•-1)#é́​中。", max_size=400), st.sampled_from([(40, 10), (25, 0), (60, 30)]))
def test_pieces_cover_the_text_within_the_limit(text, sizes):
    check(text, *sizes)


def test_cuts_fall_on_structure():
    text = "One\n\n" + "The pump runs well. " * 6 + "\n\nTwo\n\n" + "- an item\n" * 9
    pieces = split_text(text, 150, 0)
    assert pieces[0].startswith("One\nThe pump") and any(x.startswith("Two\n- an item") for x in pieces)


def test_measure_is_of_printed_text():
    assert measured(" a​  b \n\n c é ")[0] == "a b\nc é"
    assert len(split_text("x" * 999 + "​" * 50 + " \n ")) == 1 and len(split_text("x " * 501)) == 2


def test_rows_with_nulls_repeats_and_clashing_columns(spark):
    long = "word " * 300
    df = spark.createDataFrame([(1, long, 1), (1, long, 1), (2, None, 1), (3, "", 1), (4, "short", 1), (None, long, 1)], "row_id long, text string, pieces int")
    assert sorted(str(r.row_id) for r in oversized_rows(df, "row_id", "text").collect()) == ["1", "1", "None"]
    out = split_rows(df, "row_id", "text").collect()
    assert {r.row_id for r in out} == {1, 4, None} and all(len(r.piece) <= 1000 for r in out)
    assert oversized_rows(df.limit(0), "row_id", "text").count() == 0


@pytest.mark.parametrize("limit,overlap", [(0, 0), (10, 10), (10, -1)])
def test_sizes_are_checked(limit, overlap):
    with pytest.raises(ValueError):
        pieces_column(None, limit, overlap)
