from shiftwright.llm import decontamination


def test_short_items_write_their_own_words_only(spark):
    class Bits:
        value = None

    text = "w " * 50 + "needle " + "w " * 50
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "needle"), (2, "needle w"), (3, "w " * 11 + "x needle")], "item_id long, text string")
    found = {r.doc_id: r for r in decontamination.contamination(docs, items).collect()}
    assert (found[1].n_words, found[1].n_hit, found[1]["items"]) == (101, 2, ["1", "2"])

    import numpy as np

    from shiftwright.llm.common import BITMAP_BITS, with_row_key

    Bits.value = np.full(BITMAP_BITS // 8, 255, np.uint8)
    rows = decontamination.document_positions(with_row_key(docs), Bits, {1: 1, 3: 13}).first().places
    assert {len(p.around.split()) for p in rows if p["size"] == 1} == {1}
    assert max(len(p.around.split()) for p in rows if p["size"] == 3) == 23
