from __future__ import annotations

import random

import numpy as np
import pytest

from tabulith.llm import reading_level as m
from tabulith.llm.text import words

EASY = "cat dog box cup hat run sit see the big red old new we you they".split()
HARD = "heterogeneity interpolation epistemological characterization notwithstanding whereas although the of indeterminacy phenomenology proliferation substantiate".split()


def post(r, level: int, n: int = 6) -> str:
    out = []
    for _ in range(n):
        hard = (level - 1) / 4
        ws = [r.choice(HARD if r.random() < hard else EASY) for _ in range(4 + level * 4)]
        for k in range(6, len(ws), 7):
            ws[k] += ","
        out.append(" ".join([*ws, r.choice(["the", "of"]), "the"]).capitalize() + ".")
    return " ".join(out)


@pytest.fixture(scope="module")
def graded():
    r = random.Random(1)
    return [(i, post(r, i % 5 + 1), i % 5 + 1) for i in range(300)]


def test_held_out_accuracy(spark, graded):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in graded] + [(5000, None, "x"), (5001, "", "x"), (None, "a b", "x"), (0, graded[0][1], "x"), (5002, "Der Hund und die Katze laufen durch den Garten mit dem Ball. " * 5, "x")], "doc_id long, text string, level string")
    r = random.Random(2)
    labels = spark.createDataFrame([(i, min(5, max(1, y + (r.random() < 0.1))), "r") for i, _, y in graded[:200]] + [(graded[0][0], graded[0][2], "s"), (None, 3, "r"), (7, None, "r"), (99999, 2, "r")], "doc_id long, reading_level int, rater string")
    got = {x.doc_id: x for x in m.reading_levels(docs, labels).collect()}
    assert len(got) == 303 and got[5000].level is None and got[5001].own_words == 0 and got[5002].english is False and got[5002].level is None
    held = [abs(got[i].level - y) for i, _, y in graded[200:]]
    assert np.mean(held) < 0.4 and np.mean([(got[i].level >= 3.5) == (y >= 4) for i, _, y in graded[200:]]) > 0.95
    assert m.reading_levels(docs.limit(0).unionByName(docs), labels, max_labelled=100).count() == 303
    assert m.train(docs, labels.limit(0)) is None and m.reading_levels(docs, labels.limit(0)).where("level IS NOT NULL").count() == 0


def test_ranker_and_isotonic():
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 40))
    y = np.clip(np.round(3 + x[:, 0] - 0.5 * x[:, 3]), 1, 5)
    model = m.fit(x, y)
    order = np.argsort(model.score(x))
    assert np.corrcoef(np.argsort(order), y)[0, 1] > 0.85 and (np.diff(model.levels) >= 0).all() and (np.diff(model.cuts) >= 0).all()
    cuts, levels = m.isotonic(np.array([1.0, 2, 3, 4, 5, 5]), np.array([1.0, 3, 2, 4, 6, 5]))
    assert levels.tolist() == [1, 2.5, 4, 5.5] and cuts.tolist() == [1, 2.5, 4, 5]
    assert m.fit(x, np.ones(200)).level(model.score(x)).tolist() == [1.0] * 200  # all alike


OWN = "I fix the old lamp today. You see the new box."


@pytest.mark.parametrize("around", [
    "[quote=bob]Not mine at all.[/quote]\n{}", "[quote=a][quote=b]Deep.[/quote]\nMid.[/quote]\n\n{}", "[quote=a][quote=b]Deep.[/quote]\nCut off here\n\n{}", "[quote=a]Never closed\nstill\n\n{}", "<blockquote><b>x</b> said:<br/>Quoted text.</blockquote>\n\n{}",
    "> quoted line\n> more\n\n{}", "GA> \n>quoted\n\n{}", "-----Original Message-----\nFrom: zumor\nOld words here\n> More old\n\n{}", "On Tue ostzu wrote:\n> text\n\n{}", "{}\n-- \nhttp://x.invalid/~me", "{}\n_______\nSent from my thing 14", "{}\n\nbob, workshop 10, ask me",
    "{}\n\n```\n09:39:06 INFO [c94995e0] height=79549\n```", "{}\n\n[code]x = 1[/code]", "<p>{}</p>\n<p><pre>00:02:45 WARN\n1 2 3</pre></p>", "{}\n\n06:08:33 DBG [ac22ae] lot=3459 6500a98\n06:08:34 DBG [ac22ae] lot=3459 6500a98", "{}\n\n" + "Q" * 200, "[size=2][font=x]{}[/font]", "{}\n\nsee http://velra.invalid/a?id=1",
])
def test_own_prose(around):
    got = m.own_prose(around.format(OWN))
    assert [s for s in got if len(s.split()) > 1] == ["I fix the old lamp today.", "You see the new box."], got


def test_own_prose_edges():
    assert m.own_prose(None) == m.own_prose("") == m.own_prose("   \n\n") == []
    assert m.own_prose("One &quot;two&quot; *three* _four_.") == ['One "two" three four.']
    assert len(m.own_prose("word " * 200_000)) == 1


def test_pasted_items_are_no_prose(spark, graded):
    import pandas as pd

    r = random.Random(4)
    item = " ".join(r.choices([a + b for a in ("zor", "kel", "mip", "dra", "fu") for b in ("bant", "lisk", "mo", "quen")], k=40)).capitalize() + "."
    block = ((1, item),)
    posts = m._own(pd.DataFrame({"t": [f"{OWN}\n\n{item}\n\n{OWN}", OWN]}), m._items(block))
    assert [p[0] for p in posts] == [["I fix the old lamp today.", "You see the new box."] * 2, ["I fix the old lamp today.", "You see the new box."]]
    assert words(item)


def test_pasted_item_with_every_sixth_word_altered():
    """A pasted item that keeps no six words in sequence is no own prose either."""
    import pandas as pd

    from tabulith.llm import contamination

    r = random.Random(6)
    vocabulary = [a + b + c for a in "bdfgklmprst" for b in "aeiou" for c in ("nt", "rk", "sh", "mber")]
    item = r.choices(vocabulary, k=40)
    index = contamination.Items([1], [words(" ".join(item))])
    pasted = " ".join("zebra" if k % 6 == 5 else w for k, w in enumerate(item)).capitalize() + "."
    own = "We walked to the station early because the bus was late again."
    posts = m._own(pd.DataFrame({"t": [f"{own} {pasted} {own}"]}), index)
    assert [w for t in posts[0][1] for w in t if w == "zebra"] == [] and len(posts[0][0]) == 2


class Unused:
    def sub(self, *_):
        raise AssertionError("the pattern of links ran on a text without any")


def test_patterns_run_only_where_they_can_match(monkeypatch):
    r = random.Random(11)
    parts = ["a", "Bc", "7", ".", "!", "?", '"', "'", ")", "]", " ", "\n", "\t", "\x1f", "\x85", "\u2003", "www.", "http", "://", ".Com", ".net", "x.\u0131nfo", "-", "_", "\u00e9", "\u0130"]
    for _ in range(3_000):
        t = "".join(r.choices(parts, k=r.randint(0, 30)))
        assert m._unlinked(t) == m.URL.sub(" ", t)
        for p in m.re.split(r"\n\s*\n", t):
            assert m._cut(p) == m.SENTENCE.split(p)
        assert (max(map(len, t.split()), default=0) > 4) == bool(m.re.search(r"\S{5}", t))
        low = t.lower()
        assert m.tokens(t) == m.WORD.findall(low if low.isascii() else low.translate(m.CONFUSABLE))
    every = "".join(map(chr, range(128)))
    assert m.tokens(" ".join(every) + every) == m.WORD.findall((" ".join(every) + every).lower())
    monkeypatch.setattr(m, "URL", Unused())
    assert m.own_prose("It ended. Then it rained all day, and the next one too.") == ["It ended.", "Then it rained all day, and the next one too."]
