"""Line rules: counts against brute force and DuckDB, and each rule on its own line."""

import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm.line_rules import Rules, clean_lines, line_rules_sql, repeated_words

PROSE = "The river ran past the old mill, and nobody in the village could say when it had last stood still."
LINES = {
    "menu": "Home | About us | Products | Contact",
    "trail": "Home » Shop » Shoes",
    "symbols": "buy*** now$$$ the### best&&& price%%% here***",
    "shout": "FREE MONEY FOR EVERYBODY TODAY!",
    "scrap": "read the next",
    "notice": "All rights reserved.",
}


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        sum(n - 1 for n in Counter(lines).values()), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "a b a b a", "été", "$", "\n", "\n\n", " ", "\t", "\r", "x|y", "日本", "\x1c", "\xa0"]), max_size=60))
def test_counts_equal_brute_force(parts):
    text = " ".join(parts)
    assert Rules().judged(text)[:6] == plain_counts(text)


def test_windows_of_repeats():
    assert repeated_words(list("abcde"), 5) == 0
    assert repeated_words(list("abcdeabcde"), 5) == 10
    assert repeated_words(list("aaaaaaa"), 5) == 7
    assert repeated_words(list("abcdexabcdey"), 5) == 10


@pytest.mark.parametrize("name", LINES)
def test_each_rule_removes_its_line(name):
    lines = [PROSE, LINES[name], PROSE.replace("river", "stream")]
    found = Rules(max_repeat_words=100).judged("\n".join(lines))
    assert found[7] == 1 and found[8] == sum(map(len, LINES[name].split())) and found[9] == f"{lines[0]}\n{lines[2]}"
    assert found[6]  # the document itself stays
    most = "\n".join([PROSE] + [f"{LINES[name]} {i}" if name == "scrap" else LINES[name] for i in range(30)])
    assert not Rules(max_repeat_words=100).judged(most)[6]


def test_clean_lines_stay():
    for line in (PROSE, "Les.", "„Ja.“", "Was? (Nein!)", "See page 12 of the report, section 4 | part 2 for more about the river and the mill.", "NASA."):
        assert Rules(max_repeat_words=100).judged(f"{PROSE}\n{line}")[7] == 0


def test_rows_and_sql(spark):
    texts = [None, "", " \n\t", PROSE, f"{PROSE}\n{PROSE}", "\n".join([PROSE, *LINES.values()]), "日本語。\n" * 40, "x " * 50_000, " ".join(f"w{i}" for i in range(40_000)), PROSE + "\r\n" + LINES["menu"]]
    rows = [(i, t, i, "clash") for i, t in enumerate(texts)] + [(3, PROSE, 0, ""), (None, PROSE, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    found = clean_lines(docs.repartition(3), with_text=True).toPandas()
    assert len(found) == len(rows) and found.doc_id.isna().sum() == 1 and (found.doc_id == 3).sum() == 2
    by_id = {r.doc_id: r for r in found.itertuples()}
    for i, t in enumerate(texts):
        got = by_id[i]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, got.base_failed) == plain_counts(t or "")
    assert not by_id[0].kept and by_id[3].kept and by_id[5].text == PROSE
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "n_words", "kept"])  # noqa: F841
    want = duckdb.sql(line_rules_sql()).df()
    columns = [c for c in found.columns if c != "text"]
    key = lambda frame: sorted(map(repr, frame[columns].astype(object).fillna(-1).astype({"doc_id": int}).itertuples(index=False, name=None)))
    assert key(found) == key(want)
    assert clean_lines(docs.limit(0)).count() == 0
