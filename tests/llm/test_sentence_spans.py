import random
import re

import pytest

from scenewright.llm import sentence_spans as ss

SF = "/root/testdata/sf0.01"


def plain_sentences(text):
    """(start, words) of each sentence."""
    raw = (text or "").encode()
    out, last_end, stopped = [], 0, True
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
        w = m[0]
        if stopped or b"\n" in raw[last_end : m.start()]:
            out.append((m.start(), []))
        out[-1][1].append(bytes(c + 32 if 65 <= c <= 90 else c for c in w))
        core = w
        for _ in range(2):
            if len(core) > 1 and core[-1:] in (b'"', b"'", b")", b"]"):
                core = core[:-1]
        last_end, stopped = m.end(), core[-1:] in (b".", b"!", b"?")
    return out


def brute_force(rows):
    runs = {}
    per_doc = []
    for d, text in rows:
        s = plain_sentences(text)
        n = len(s)
        spans = set()
        for i in range(n):
            for j in range(i + ss.SENTENCES, n + 1):
                if sum(len(w) for _, w in s[i:j]) >= ss.LEAST_WORDS:
                    spans.add((i, j))
                    break
            for k in range(i + 1 - ss.SENTENCES, -1, -1):
                if sum(len(w) for _, w in s[k : i + 1]) >= ss.LEAST_WORDS:
                    spans.add((k, i + 1))
                    break
        per_doc.append((d, text, s, spans))
        for i, j in spans:
            key = tuple(tuple(w) for _, w in s[i:j])
            at = (ss.LAST if d is None else d, i)
            runs[key] = min(runs.get(key, at), at)
    out = []
    for d, text, s, spans in per_doc:
        gone = set()
        for i, j in spans:
            if runs[tuple(tuple(w) for _, w in s[i:j])] != (ss.LAST if d is None else d, i):
                gone |= set(range(i, j))
        raw = (text or "").encode()
        edge = [0, *[b for b, _ in s[1:]], len(raw)]
        left = b"".join(raw[edge[k] : edge[k + 1]] for k in range(len(s)) if k not in gone) if gone else raw
        out.append((d, None if text is None else left.decode(), len(s), len(gone)))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([("x", d, t, 1.0) for d, t in rows], "hash string, doc_id long, text string, place double")
    out = ss.remove(df, report=True)
    assert out.columns == [*df.columns, "__sentences", "__removed"]
    return sorted([(r.doc_id, r.text, r["__sentences"], r["__removed"]) for r in out.collect()], key=repr)


def test_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_force(rows)
    got = ss.remove(spark.read.parquet(f"{SF}/documents.parquet"), report=True)
    assert sorted([(r.doc_id, r.text, r["__sentences"], r["__removed"]) for r in got.collect()], key=repr) == want
    assert sum(w[3] > 0 for w in want) > 20


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcXYZ", k=3))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 12))) + rng.choice([". ", "! ", '." ', "\n", "?\n\n"])
    passages = ["".join(sentence() for _ in range(rng.randrange(2, 9))) for _ in range(8)]
    rows = [(i, "".join(rng.choice([sentence(), sentence(), rng.choice(passages)]) for _ in range(rng.randrange(8)))) for i in range(120)]
    assert run(spark, rows) == brute_force(rows)


def test_planted_passage_and_edges(spark):
    passage = "One thing is certain today. Nobody has ever seen the far side of that old hill, or so they say. It is, then, a mystery! We walked for hours in the rain without a word. At last the path ended by a small stone house. Its door stood open. Inside we found a table, two chairs and a lamp that still burned."
    rows = [(3, f"Alpha is first. {passage} Omega ends this."), (1, f"Some other start here.\n{passage.upper()}\nAnd more."), (2, passage), (2, passage), (None, passage), (7, None), (7, ""), (8, "short. text."), (9, f"{passage} {passage}"), (10, "word " * 200_000 + ". " + "b. " * 40)]
    got = run(spark, rows)
    assert got == brute_force(rows)
    left = {r[0]: r[1] for r in got}
    assert left[1] == rows[1][1] and left[3] == "Alpha is first. Omega ends this." and left[2] == "" and left[9] == ""
    assert run(spark, []) == []


def test_rows_that_share_an_id_or_have_none(spark):
    """Each row is a document of its own: what is cut is what a table with other ids in the same order loses."""
    one = "Here is a first passage of eight words. It goes on with a second sentence of some length."
    two = "Another passage stands here for the test. Its end is a sentence that has many words too."
    texts = [f"{one} Only here is this.", f"{one} And this is other.", f"{two} {one}", "short. text.", f"A start. {two}", f"{one} {two} A third one. {one}", None, ""]
    for key in (None, 5):
        rows = [(key, t) for t in texts] + [(1, f"Before. {two}")]
        sums = [r[0] for r in spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k int, text string").selectExpr("k", "xxhash64(text) AS h").orderBy("k").select("h").collect()]
        order = sorted(range(len(rows)), key=lambda k: (ss.LAST if rows[k][0] is None else rows[k][0], sums[k]))
        want = brute_force([(n, rows[k][1]) for n, k in enumerate(order)])
        assert run(spark, rows) == sorted([(rows[order[n]][0], *rest) for n, *rest in want], key=repr)
        assert sum(w[3] > 0 for w in want) >= 4


def test_equal_texts_without_an_id(spark):
    text = "Here is a first passage of eight words. It goes on with a second sentence of some length."
    assert [r[1:] for r in run(spark, [(None, text)] * 3)] == [("", 2, 2), ("", 2, 2), (text, 2, 0)]
    assert [r[1:] for r in run(spark, [(4, text)] * 2)] == [(text, 2, 0)] * 2
