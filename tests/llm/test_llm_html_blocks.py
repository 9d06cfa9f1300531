"""Bad parts inside an article do not cut it, however long they are."""

import pytest

from flowlens.llm.html_extract import Weights, main_text

BLOCKS = ['<div class="ad"><p>{}</p></div>', "<aside><ul><li>{}</li></ul></aside>", "<form><b>{}</b><input></form>", '<section id="comments"><div>{}</div></section>', "<script>{}</script>"]
LEARNED = Weights({"article": 4.0, "div.content": 4.0, "div.ad": -4.0, "aside": -4.0, "form": -4.0, "section.comments": -4.0, "script": -4.0}, {"bad div": -2.02, "bad p": -2.02, "good div": -2.02})


@pytest.mark.parametrize("weights", [Weights(), LEARNED])
@pytest.mark.parametrize("opening", ["<article>", '<div id="content">'])
@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("bad", [10, 100])
@pytest.mark.parametrize("closing", [3, 40])
def test_a_block_before_the_closing_paragraph(weights, opening, block, bad, closing):
    first, last = " ".join(f"a{i}" for i in range(60)), " ".join(f"z{i}" for i in range(closing))
    inner = block.format(" ".join(["buy"] * bad))
    close = f"</{opening[1:].split('>')[0].split()[0]}>"
    nav = "<nav>" + "<a>home</a> " * 20 + "</nav>"
    tail = "<footer>" + "foot " * 20 + "</footer>"
    page = f"<html><body>{nav}{opening}<p>{first}</p>{inner}<p>{last}</p>{close}{tail}</body></html>"
    assert main_text(page, weights) == f"{first} {last}"
    page = f"<html><body>{nav}{opening}<h1>{last}</h1>{inner}<p>{first}</p>{close}{tail}</body></html>"
    assert main_text(page, weights) == f"{last} {first}"
