import hypothesis
from hypothesis import strategies as st

from sunledger.llm import quality as Q

from .conftest import ODD

GOOD = "The first sentence of a text says something. " * 1 + "The second one adds what the first has left out.\nA third line ends it."


def brute_repeats(words, width=5):
    windows = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
    return len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + width)})


@hypothesis.given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30))
@hypothesis.settings(max_examples=200, deadline=None)
def test_repeated_windows(words):
    assert Q.repeated_window_words(words) == brute_repeats(words)


def test_counts_of_one_text():
    r = Q.judge("a b|\x0bc\na b|\x0bc\n\n d #  e")
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (9, 12, 3, 1)


def test_line_rules():
    for rule, line in {
            "navigation": "Home | News | Contact | About", "symbols": "buy### now$$$ cheap%%%", "shouting": "BUY!! THIS!! NOW!!",
            "punctuation": "word " * 50, "boilerplate": "All Rights Reserved 2020", "repeats": "no no no no yes yes yes yes so so"}.items():
        assert Q.line_fails(line, len(line.split())) == rule
    assert Q.line_fails("A plain sentence, of some words.", 6) == ""


def test_documents_lose_bad_lines_or_go(documents):
    rows = [(1, GOOD), (2, GOOD + "\nHome | News | Contact"), (3, "Home | News | Contact | More | And more | Yet more\n" * 4 + "Few."),
            (4, "Too short.")]
    kept = {r.doc_id: r.text for r in Q.quality_filter(documents(rows)).collect()}
    assert kept == {1: GOOD, 2: GOOD}


def test_odd_rows(documents):
    rows = {}
    for r in Q.quality_report(documents(ODD)).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert len(rows[4]) == 3 and [r.n_words for r in rows[1]] == [0] and rows[2][0].base_failed and not rows[3][0].kept
    assert rows[7][0].n_repeat_words == 3000 and rows[6][0].word_chars == 5000
    assert Q.quality_report(documents([])).count() == 0 and Q.quality_filter(documents([])).count() == 0
