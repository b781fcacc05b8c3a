"""Ranked search, fill-in-the-middle and chat formatting against brute force, on planted and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from volspan.llm import chat, fim, fptree
from volspan.llm import queries as Q

# ---- document FP-trees

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
COMMON = "the of and to in is that it for was".split()
RARE = [f"w{i}" for i in range(60)] + ["été", "ſK", "日本", "İx"]


def terms(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), t) for t in TERM.findall(text or "")]


def ranked(docs, items, top=20):
    """(item place, rank, id, score) by scoring every pair."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n_docs, n_all = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for place, (_, text) in enumerate(items):
        scored = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(place, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:top])]
    return out


def corpus():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(COMMON) if rng.random() < 0.7 else rng.choice(RARE) for _ in range(n))
    docs = [(i, say(rng.choice([3, 20, 80, 300]))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(150)] + [(1000 + i, docs[7][1]) for i in range(3)]  # copies, some of one id
    docs += [(2000, None), (2001, ""), (2002, " ,;- \x1c\x7f"), (None, docs[9][1]), (None, docs[7][1]), (2003, "the " * 40_000 + "W1 w1"), (2004, "THE-Of_and{W5}"), (2005, "x" * 200_000)]
    items = [(i, say(12)) for i in range(20)] + [(3, "w1 w1 w2 the"), (None, "of été"), (30, None), (31, "nothing here"), (32, docs[7][1]), (33, "été İx ſk ſK")]
    return docs, items


def test_search_equals_scoring_every_pair(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit("clash"), "score": F.lit(1), "item_id": F.lit(2), "n": F.lit(3)}).repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit("clash"), "item": F.lit(1)})
    expected = sorted((items[p][0] is None, items[p][0] or 0, r, i is None, i or 0, s) for p, r, i, s in ranked(docs, items))
    for most_items in (1_000, 4):  # one block of items, and several
        got = fptree.lexical_search(d, it, most_items=most_items)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((r.item_id is None, r.item_id or 0, r["rank"], r.doc_id is None, r.doc_id or 0, r.score) for r in got.collect()) == expected


def test_search_on_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, "c")], "item_id long, text string")
    assert fptree.lexical_search(docs.where("false"), items).count() == 0
    assert fptree.lexical_search(docs, items.where("false")).count() == 0
    assert [tuple(r) for r in fptree.lexical_search(docs, items).collect()] == [(1, 1, 1, ranked([(1, "a b")], [(1, "a")])[0][3])]


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_tree_bounds_hold_and_cut(leaf):
    """Every node bounds what is below it, leaves share the documents out, and a search skips some of them."""
    rng = np.random.default_rng(leaf)
    n, v = 500, 40
    lists = [np.sort(rng.choice(v, min(v, 1 + int(rng.exponential(6))), replace=False, p=(w := 1.0 / np.arange(1, v + 1)) / w.sum())) for _ in range(n)]
    lists[100:220] = [lists[3]] * 120
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    counts = rng.integers(1, 9, at[-1])
    m, ids = rng.integers(80, 400, n), rng.permutation(n)
    tree = fptree.Tree(ids, m, at, np.concatenate(lists), counts, v, leaf)
    leaves = [i for i in range(len(tree.low)) if not tree.children[i]]
    assert sorted((tree.low[i], tree.high[i]) for i in leaves) == [(a, b) for a, b in zip(sorted(tree.low[i] for i in leaves), sorted(tree.high[i] for i in leaves), strict=True)]
    assert sum(tree.high[i] - tree.low[i] for i in leaves) == n
    by_id = {int(i): k for k, i in enumerate(ids)}
    for row, i in enumerate(tree.ids):  # rows are the documents
        own = by_id[int(i)]
        assert tree.m[row] == m[own] and np.array_equal(np.flatnonzero(tree.counts[row]), lists[own])
    paths = [tuple(np.flatnonzero(r)) for r in tree.counts]
    assert paths == sorted(paths)  # equal beginnings lie together
    skipped = 0
    for _ in range(30):
        asked = rng.choice(v, 5, replace=False)
        weights = rng.integers(1, 5000, 5)
        exact = fptree.scores(tree.counts[:, asked], tree.m, weights)
        bound = fptree.scores(tree.most[:, asked], tree.least_m, weights)
        for node in range(len(tree.low)):
            assert bound[node] >= exact[tree.low[node] : tree.high[node]].max() and tree.least_id[node] == tree.ids[tree.low[node] : tree.high[node]].min()
        best = fptree.Best(10)
        skipped += n - fptree.search(tree, asked, weights, best)
        order = sorted((-s, i) for s, i in zip(exact.tolist(), tree.ids.tolist(), strict=True) if s > 0)[:10]
        assert list(zip(best.scores.tolist(), best.ids.tolist(), strict=True)) == [(-s, i) for s, i in order]
    assert skipped > 0


def test_terms_are_those_of_the_pattern():
    texts = ["Été a1_b-c\x00D", None, "", "ſK İ 日本-語\x7fx", "z" * 700_000 + " Z"]
    hashes, at = fptree.terms_of(pa.array(texts, pa.string()))
    own, ends = fptree.terms_of(pa.array([t for x in texts for t in terms(x)], pa.string()))
    assert np.diff(at).tolist() == [len(terms(t)) for t in texts] and hashes.tolist() == own.tolist()


# ---- fill in the middle

ODD = [None, "", "a", "ab", "é日本🙂", "holds <P> a mark", "<M>", "<S", "<", "P>", "<<<PSM>>>", "S>x<", " \n\x00 ", "x<P" * 50, "éa" * 200_000, "🙂<" * 70_000]


def groups(doc_id):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def expected_fim(doc_id, text):
    text, (h1, h2, h3, h4) = text or "", groups(doc_id)
    n = len(text)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", lo, hi - lo, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fim_on_odd_rows(spark):
    rows = [(100 * k + i, t, "clash", 1.5) for k in range(6) for i, t in enumerate(ODD)] + [(None, "no id here", "clash", 1.5), (7, ODD[4], "clash", 1.5), (7, ODD[4], "clash", 1.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n double").withColumn("fim", F.lit("replaced"))
    made = fim.restore(fim.fill_in_middle(df, out="fim")).collect()
    assert len(made) == len(rows) and made[0].__fields__ == ["doc_id", "text", "form", "n", "fim", "restored"]
    for r in made:
        assert tuple(r.fim) == expected_fim(r.doc_id, r.text) and r.restored == (r.text or "") and (r.form, r.n) == ("clash", 1.5)
    assert {r.fim.form for r in made} == {"plain", "spm", "psm"}
    assert fim.restore(fim.fill_in_middle(df.where("false"))).count() == 0
    assert all(r.fim.form == "spm" for r in fim.fill_in_middle(df.where("doc_id = 3"), percent=100, spm_percent=100).collect())


def test_rotations_in_place(monkeypatch):
    rng = random.Random(5)
    for piece in (1, 2, 7, 64 << 10):
        monkeypatch.setattr(fim, "PIECE", piece)
        for _ in range(200):
            raw = rng.randbytes(rng.randint(0, 60))
            a, b, c = sorted(rng.randint(0, len(raw)) for _ in range(3))
            buffer = bytearray(raw)
            fim.rotate(buffer, a, b, c)
            assert bytes(buffer) == raw[:a] + raw[b:c] + raw[a:b] + raw[c:]
            fim.rotate(buffer, a, a + c - b, c)
            assert bytes(buffer) == raw
            text = "".join(rng.choice("aé日🙂<PSM>") for _ in range(rng.randint(0, 30)))
            if any(m in text for m in ("<P>", "<S>", "<M>")):
                continue
            lo, hi = sorted(rng.randint(0, len(text)) for _ in range(2))
            for form in ("psm", "spm"):
                out = fim.arranged(text.encode(), form, lo, hi - lo)
                parts = {"psm": f"<P>{text[:lo]}<S>{text[hi:]}<M>{text[lo:hi]}", "spm": f"<S>{text[hi:]}<P>{text[:lo]}<M>{text[lo:hi]}"}
                assert out.decode() == parts[form] and fim.restored(out, form).decode() == text


# ---- chat formatting


def formatted(turns, learned=("assistant",)):
    """The format and its mask (a flag for each code point), turn by turn."""
    esc = lambda t: t.replace("\\", "\\\\").replace("</turn>", "\\e").replace("<more/>", "\\m").replace("### ", "\\h")
    out, mask, before = "", [], None
    for role, text in turns:
        head = "<more/>" if role == before else ("</turn>\n" if out else "") + "### " + esc(role).replace("\n", "\\n") + ":\n"
        out += head + esc(text)
        mask += [False] * len(head) + [role in learned] * len(esc(text))
        before = role
    return out + "</turn>\n", mask + [False] * 8


def unrolled(runs, n):
    mask = []
    for r in runs:
        mask += [False] * r.skip + [True] * r.take
    return mask + [False] * (n - len(mask))


def test_chats_on_odd_turns(spark):
    rng = random.Random(6)
    pieces = ["\\", "</turn>", "<more/>", "### ", "###", "</turn", ">", "\n", "\\e", "\\\\h", "é", "🙂", "assistant:", " ", "x", "<", "/>", "$1"]
    odd = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
    roles = ["user", "assistant", "assistant", "system", "", "a:\nb", "### \\n", "</turn>\n"]
    chats = {i: [(k, rng.choice(roles), odd()) for k in range(rng.randint(1, 9))] for i in range(120)}
    chats[200] = [(0, "user", None), (1, None, None), (2, "assistant", None), (3, "assistant", "y" * 300_000)]
    chats[201] = [(0, "user", "b"), (0, "user", "a"), (0, "assistant", "a"), (None, "user", "first"), (5, "assistant", "end"), (5, "assistant", "end")]
    chats[202] = [(k, "assistant" if k % 3 else "user", f"turn {k}") for k in range(3_000)]
    chats[None] = [(0, "assistant", "no id")]
    rows = [(i, t, r, x, "clash") for i, c in chats.items() for t, r, x in c]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").withColumn("blocks", F.lit(1))
    made = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert made.keys() == chats.keys()
    for i, c in chats.items():
        said = [(r or "", x or "") for _, r, x in sorted(c, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))]
        out, mask = formatted(said)
        got = made[i]
        assert got.formatted == out and unrolled(got.loss_runs, len(out)) == mask and len(mask) == len(out)
        assert [tuple(t) for t in got.turns] == said
        assert "".join(got.learned) == "".join(x for r, x in said if r == "assistant")
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0
    both = chat.read_back(chat.format_chats(df.where("conv_id = 202"), learned=("assistant", "user"))).first()
    assert len(both.learned) == 3_000


def test_chat_query_runs_without_python_workers(spark):
    plan = Q.op13_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = {r.conv_id: r for r in Q.op13_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    text = Q.CONTROL
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == len(text) and rows[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
