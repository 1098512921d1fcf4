import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from folium.llm import quality_rules as Q
from helpers import ODD, documents, frame


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_stutters": sum(a == b for a, b in zip(words, words[1:])),
    }


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b\r#|!X😀", max_size=60), min_size=1, max_size=40))
def test_measurements_equal_brute_force(spark, texts):
    texts += ODD
    got = {r["doc_id"]: r.asDict() for r in Q.ledger(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = brute(text)
        assert {k: got[i][k] for k in want} == want


def test_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(40))
    texts = [good, "few words", good.upper() + " WORD!! NEXT!!", " ".join(f"w{i}$$$$" for i in range(40)), None]
    book = Q.ledger(documents(spark, texts)).cache()
    verdicts = {
        p: [r["kept"] for r in Q.apply_policy(book, p).orderBy("doc_id").collect()] for p in Q.POLICIES
    }
    assert verdicts["strict-2"] == [True, False, False, False, False]
    assert verdicts["base-1"] == [True, False, True, True, False]
    rows = {(r["policy"], r["rule"]): r for r in Q.ablations(book).collect()}
    assert rows["strict-2", "few_words"]["failing"] == 2
    assert rows["strict-2", "symbols"]["rejected_alone"] == 1
    assert rows["base-1", "few_words"]["rejected_by_policy"] == 2


def test_keep_returns_the_columns_it_got(spark):
    docs = frame(spark, [(1, "x", 9, 8), (None, " ".join(map(str, range(100, 140))), 9, 8)], "doc_id long, text string, failed_bits int, _bits int")
    kept = Q.keep(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.select("doc_id", "_bits").collect()] == [(None, 8)]


def test_scripts_without_spaces_stay(spark):
    text = " ".join(chr(0x4E00 + i) * 2 + "".join(chr(0x5000 + 31 * i + k) for k in range(40)) for i in range(12))
    docs = frame(spark, [(1, text)], "doc_id long, text string")
    assert Q.keep(docs).count() == 1
    assert Q.keep(docs, "strict-2").count() == 0


def test_word_length_is_judged_in_every_script(spark):
    """The applied policy looks at word lengths; only characters of unspaced scripts don't count above 25."""
    chinese = " ".join("".join(chr(0x5000 + 31 * i + k) for k in range(40)) for i in range(12))
    texts = [
        " ".join("abcdefghijklmnop"),  # single letters
        " ".join(f"{i:02d}" + "x" * 40 + "y" * i for i in range(12)),  # long strings of a spaced script
        chinese + " https://example.com/" + "z" * 60 + " 1",  # an address among sentences
        " ".join(f"{i:02d}" + "x" * 400 + chr(0x5000 + i) for i in range(12)),  # one sign doesn't excuse them
        " ".join(f"word{i}" for i in range(40)),
    ]
    book = Q.ledger(documents(spark, texts))
    rows = Q.apply_policy(book).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [False, False, True, False, True]
    assert [r["n_unspaced"] for r in rows] == [0, 0, 480, 12, 0]
    # Where no such sign stands, the verdict is that of all first eight rules.
    older = Q.apply_policy(book, "strict-2").orderBy("doc_id").collect()
    assert [r["kept"] for r in older] == [False, False, False, False, True]
