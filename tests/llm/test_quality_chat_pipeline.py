"""Quality rules, chat formatting and the pipeline against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postlens.llm import chat, quality
from postlens.llm.common import read

from . import odd
from .test_near_dup import brute_lines, shingles


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_measures_of_odd_rows(spark):
    docs = odd.documents(spark)
    more = spark.createDataFrame([(100, "a b c a b c a b"), (101, "x\nx\n \nx\ny"), (102, "a a a a"), (103, "#$ %|\n<>& *")], "doc_id long, text string")
    both = docs.select("doc_id", "text", "lang", "kept").unionByName(more, allowMissingColumns=True)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter((r["doc_id"], *(r[n] for n in names)) for r in quality.judge(both).collect())
    assert got == Counter((r["doc_id"], *measures(r["text"])) for r in both.collect())
    assert quality.judge(odd.empty(spark)).count() == 0


def distance(p, q):
    p, q = ([x / sum(h) for x in h] for h in (p, q))
    part = lambda x, m: x * math.log2(x / m) if x else 0.0
    return math.sqrt(sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q)) / 2)


def test_divergence_rejects_strange_text_only(spark):
    rng = random.Random(1)
    common = [f"c{i}" for i in range(20)]
    plain = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else f"rare{rng.randrange(10**6)}" for _ in range(n)) + "."
    rows = [(i, plain(rng.randint(100, 300)), "en") for i in range(150)]
    rows += [(1000, " ".join(f"{rng.randrange(10**6)}###$$$" for _ in range(120)), "en"), (1001, plain(60), "en"), (1002, "##1 $$2 " * 1, "xx"),
             (1003, " ".join(f"R{rng.randrange(10**6)}%%%" for _ in range(90)), "tiny")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(150)) and not got[1000]["kept"] and not got[1000]["base_failed"]
    assert got[1001]["kept"] and got[1001]["word_distance"] is None
    assert got[1003]["kept"] and got[1003]["word_distance"] is None  # its language has too little text
    counts = Counter(w for _, t, lang in rows if lang == "en" for w in t.split())
    top = sorted(counts, key=lambda w: (-counts[w], w))[:20]
    words = rows[0][1].split()
    hist = [words.count(w) for w in top] + [sum(w not in top for w in words)]
    ref = [counts[w] for w in top] + [sum(counts.values()) - sum(counts[w] for w in top)]
    assert got[0]["word_distance"] == pytest.approx(distance(hist, ref))


# --- chat ---------------------------------------------------------------------------------


def logged():
    rng = random.Random(6)
    rows = []
    for c in range(60):
        n = rng.randint(1, 9)
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "", None, f"t{c}"])) for _ in range(n)]
        for k in {rng.randint(1, n), rng.randint(1, n), n}:
            rows += [(len(rows) * 100 + c, i, *t) for i, t in enumerate(turns[:k])]
    by = defaultdict(list)
    ids = {}
    for key, i, role, text in rows:
        if i == 0:
            ids[key] = current = key
        by[current].append((i, role, text))
    return {k: sorted(v, key=lambda t: t[0]) for k, v in by.items()}


def brute_chat(by):
    plain = {k: tuple((r, t) for _, r, t in v) for k, v in by.items()}
    out = {}
    for key, turns in plain.items():
        if min(k for k, t in plain.items() if t == turns) == key and not any(len(t) > len(turns) and t[:len(turns)] == turns for t in plain.values()):
            text = "".join(f"<|{r or 'unknown'}|>\n{t or ''}\n<|end|>\n" for r, t in turns)
            out[key] = (len(turns), sum(t == turns for t in plain.values()), text)
    return out


@pytest.mark.parametrize("chunk", [256, 2])
def test_maximal_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    by = logged()
    rows = [(k, i, r, t) for k, v in by.items() for i, r, t in v]
    frame = spark.createDataFrame(rows + rows[:40], "conv_id long, turn long, role string, text string").withColumn("part", F.lit("own"))
    found = defaultdict(list)
    for r in chat.render(frame).collect():
        found[r["conv_id"], r["n_turns"], r["copies"]].append((r["part"], r["text"]))
    assert {k: (n, c, "".join(t for _, t in sorted(parts))) for (k, n, c), parts in found.items()} == brute_chat(by)


def test_odd_turns(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (1, None, "user", "x"), (1, None, "user", "y"), (2, 5, "user", odd.LONG), (2, 5, "user", odd.LONG), (2, 9, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.render(frame).collect()}
    assert got[None] == (2, "<|unknown|>\n\n<|end|>\n<|user|>\na\n<|end|>\n") and got[1][0] == 2
    assert got[2] == (2, f"<|user|>\n{odd.LONG}\n<|end|>\n<|unknown|>\n\n<|end|>\n")
    assert chat.render(frame.limit(0)).count() == 0


# --- pipeline -----------------------------------------------------------------------------


def test_stages_against_their_inputs(spark, sf):
    docs = read(spark, sf, "documents").cache()
    own = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "MinHash near-dedup", "mixing", "best-fit packing"]
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf).cache()
    assert clean.columns == own and 0 <= docs.count() - clean.count() < 0.2 * docs.count() and clean.exceptAll(docs).count() == 0
    lines = stages["line dedup"](spark, clean, sf).cache()
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    want = {k: t for k, t in brute_lines(sorted(before.items())).items() if t.strip() or not before[k].strip()}
    assert lines.columns == own and {r["doc_id"]: r["text"] for r in lines.collect()} == want
    assert lines.where("n_chars <> char_length(text)").count() == 0
    kept = stages["MinHash near-dedup"](spark, lines, sf).cache()
    ids = {r["doc_id"] for r in kept.collect()}
    sets = {k: shingles(t) for k, t in want.items()}
    links = {k: [j for j in want if j != k and len(sets[j] & sets[k]) * 100 >= 85 * max(len(sets[j] | sets[k]), 1)] for k in want}
    assert kept.columns == own and all((k in ids) != bool(links[k]) or k in ids or any(j in links[k] for j in want if j < k) for k in want)
    assert all(k in ids for k in want if not links[k])
    mixed = stages["mixing"](spark, kept, sf).cache()
    texts = {r["doc_id"]: Counter(r["text"].split()) for r in kept.collect()}
    assert mixed.columns == own
    for r in mixed.collect():
        assert not Counter(r["text"].split()) - texts[r["doc_id"]]
    packed = stages["best-fit packing"](spark, mixed, sf).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())
    assert max(Counter(r["sequence_id"] for r in packed for _ in r["input_ids"]).values()) <= 4096
