import time

import pytest

from shiftwright.llm import html_text

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<a \"> " * 150_000, "<div>" * 50_000 + "</b>" * 100_000, "<b><p></p>" * 60_000, "<a<a" * 200_000,
    "<!-- " * 200_000, "<" * 500_000 + ">", "<div>x" * 100_000, "<span>" * 50_000 + "<p>x" * 50_000,
], ids=range(9))
def test_long_odd_pages_take_as_long_as_they_are(page):
    begun = time.process_time()
    html_text.blocks_of(page)
    assert time.process_time() - begun < 5


def test_deep_paths_are_shared():
    blocks = html_text.blocks_of("<div>x" * 20_000)
    assert len(blocks) == 20_000 and len(blocks[99].path) == 100
    vectors = html_text.Vectors().page(blocks)
    assert vectors.shape[0] == 20_000 and (vectors[0, : html_text.PATH_CELLS] == vectors[-1, : html_text.PATH_CELLS]).all()


@pytest.mark.parametrize("page,texts", [
    ("a<a b", ["a"]), ("<p>a<!-- b <p>c", ["a"]), ("<p title=\"x>y\">a</p>b", ["a", "b"]), ("<p title=\"x>a", ["a"]), ("5 < 6 > 4", ["5 < 6 > 4"]),
    ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<p>a<b>b</i>c</b></p>", ["abc"]), ("a<!--b--!>c", ["ac"]),
])
def test_blocks(page, texts):
    assert [b.text for b in html_text.blocks_of(page)] == texts


def sentence(k):
    return f"The river rose for {k} days before the people of the valley moved their boats to the upper meadow."


def test_pages_written_by_hand(spark):
    """No class or id of these pages is in a list of the teacher; what is left out stands in elements that say so."""
    body = "".join(f"<p>{sentence(k)}</p>" for k in range(6))
    wanted = "\n".join(sentence(k) for k in range(6))
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(5)) + "</ul>"
    pages = {
        1: f"<html><body><nav class='zz1'>{menu}</nav><article class='qq7'>{body}</article><footer class='zz2'>Imprint</footer></body></html>",
        2: f"<html><head><title>T</title></head><body><header class='w1'>{menu}</header><main id='k9'>{body}</main>"
           f"<aside class='w4'><p>See also the other valley.</p></aside><script>if(a<b){{x()}}</script></body></html>",
        3: "", 4: None,
    }
    frame = spark.createDataFrame([(k, f"http://h/{k}", p) for k, p in pages.items()], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_text.main_text(frame, training=spark.read.parquet(PAGES)).collect()}
    assert found == {1: wanted, 2: wanted, 3: "", 4: ""}
