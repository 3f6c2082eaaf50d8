import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import xxhash

from fathomline.llm import induced, kneser_ney, simhash, suffix_dedup, toxicity
from fathomline.llm.common import table
from tests.llm.helpers import ODD, docs, prose


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- toxicity -------------------------------------------------------------------------------------------------------


def test_transducers_compose():
    assert len(toxicity.FOLLOW) == (toxicity.SCOPE + 1) * 2 * (toxicity.REACH + 1)

    def marks(symbols):
        state, out = toxicity.START, []
        for s in symbols:
            k = toxicity.SYMBOLS.index(s)
            out.append(toxicity.MARKS[state][k])
            state = toxicity.FOLLOW[state][k]
        return out

    assert marks("NOI")[-1] == "n" and marks("NOOOOI")[-1] == "" and marks("ROOOOOOI")[-1] == "r" and marks("TI")[-1] == "t"
    assert set(marks("RTNI")[-1]) == {"n", "r", "t"}


def slow_paths(grammar, text):
    """The heaviest path of each clause, read sentence by sentence from the rules as they are worded."""
    out, at = [], 0
    for sentence in re.split(r"([.!?\n])", text):
        tokens = [(m.group(), m.start() + at) for m in toxicity.TOKEN.finditer(sentence)]
        clauses = [[]]
        for w, i in tokens:
            if w[0].isalnum() or w[0] == "_":
                clauses[-1].append((w, i))
            else:
                clauses.append([])
        reported = False
        for words in clauses:
            best = (0.0, None)
            for k, (w, i) in enumerate(words):
                insult = grammar.insult(w)
                symbols = ["I" if grammar.insult(x) else toxicity.FIXED.get(x, "O") for x, _ in words[:k]]
                if insult or w in toxicity.THREATS:
                    kind = "I" if insult else "H"
                    kind += "n" if "N" in symbols[-toxicity.SCOPE :] else ""
                    kind += "r" if reported or "R" in symbols else ""
                    kind += "t" if "T" in symbols[-toxicity.REACH :] else ""
                    mass = toxicity.multiplier(kind, toxicity.PRIOR) * (insult or toxicity.PRIOR["H"])
                    if mass > best[0]:
                        best = mass, (i, i + len(w), kind, insult or 1.0)
            reported = reported or any(toxicity.FIXED.get(x) == "R" and not grammar.insult(x) for x, _ in words)
            if best[1]:
                out.append(best[1])
        at += len(sentence)
    return out


def test_matches_by_clause():
    g = toxicity.Grammar(words={"idiot": 3.0}, stems={"moro": 2.0})
    kinds = [k for *_, k, _ in g.matches("you are an idiot. he said, this moronic plan is not an idiot, idiotic. never an idiot")]
    assert kinds == ["It", "Irt", "In"]
    assert g.matches("") == [] and g.matches("idiotic idioty") == []
    long_ = " ".join(["he said"] + ["word"] * 5000 + ["idiot"])
    assert [k for *_, k, _ in g.matches(long_)] == ["Ir"]
    rng = np.random.default_rng(6)
    parts = ["idiot", "moronic", "kill", "you", "this", "not", "never", "said", "told", "word", "other", ",", ",", ";", ".", "!", "\n", "idiotx", "xidiot"]
    for _ in range(400):
        text = " ".join(rng.choice(parts, size=rng.integers(1, 60)))
        assert g.matches(text) == slow_paths(g, text)


def test_marks_order_scores():
    """A negated or reported insult weighs less than a plain one and a targeted one no less, whatever was learned."""
    rng = np.random.default_rng(1)
    kinds = np.zeros((400, 2 * len(toxicity.KINDS)))
    y = (np.arange(400) % 3 == 0).astype(float)
    for k in range(400):  # labels that would have it the other way round
        at = toxicity.KINDS.index("In" if y[k] else "I") if rng.random() < 0.8 else toxicity.KINDS.index("Ir")
        kinds[k, [at, at + len(toxicity.KINDS)]] = 3.0
    for data in (kinds, kinds[:0]):
        g = toxicity.Grammar(words={"idiot": 3.0})
        if len(data):
            toxicity.learn(g, data, y)
        score = {t: g.score(g.matches(t)) for t in ("an idiot came", "not an idiot came", "he then said an idiot came", "you idiot came", "it came")}
        assert score["not an idiot came"] <= score["an idiot came"] <= score["you idiot came"]
        assert score["he then said an idiot came"] <= score["an idiot came"] and score["it came"] <= score["not an idiot came"]
    plain, negated = (toxicity.Grammar(words={"idiot": 3.0}).score([(0, 1, k, 3.0)]) for k in ("I", "In"))
    assert negated < plain


def test_toxicity_learns_from_labels(spark):
    rows, marks = [], []
    for k in range(600):
        bad = k % 6 == 0
        text = prose(k, 25).split()
        if bad:
            text.insert(k % 20, ["grobnik", "blarg" + "xyz"[k % 3]][k % 2])
        rows.append((k, " ".join(text), "en", "a"))
        marks.append((k, 1, int(bad)))
    rows += [(1000 + k, t, lang, s) for k, (_, t, lang, s) in enumerate(ODD)] + [(None, "grobnik", "en", "a")]
    d, y = docs(spark, rows), labels(spark, [*marks, (None, 1, 1), (3, None, None), (99_999, 1, 1)])
    got = toxicity.judged(d, y).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in marks}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    kept = toxicity.accepted(d, toxicity.fit(d, y))
    assert kept.columns == d.columns and kept.count() == sum(not r.predicted for r in got)
    assert toxicity.judged(docs(spark, []), labels(spark, [])).count() == 0
    assert toxicity.judged(d, labels(spark, [])).filter("predicted = 1").count() == 0


def test_toxicity_holds_on_a_table(spark, sf):
    """Held-out documents of a table that training did not see; marks decide some predictions."""
    folder = sf.replace("sf0.001", "sf0.1")
    d, y = table(spark, folder, "documents"), table(spark, folder, "labels")
    g = toxicity.fit(d, y)
    truth = {r.doc_id: r.t for r in y.groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "t").collect()}
    found = [(r.doc_id, r.score, [tuple(m) for m in r.matches]) for r in toxicity.score(d, g).collect()]
    held = [(truth[i], s >= toxicity.THRESHOLD) for i, s, _ in found if i in truth and zlib.crc32(str(i).encode()) % 4 == 2]
    toxic, clean = [p for t, p in held if t == 1], [p for t, p in held if t == 0]
    assert np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.02
    bare = [g.score([(a, b, k[0], w) for a, b, k, w in m]) >= toxicity.THRESHOLD for *_, m in found]
    assert bare != [s >= toxicity.THRESHOLD for _, s, _ in found]


# --- simhash --------------------------------------------------------------------------------------------------------


def slow_fingerprint(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[k : k + n] for k in range(len(w) - n + 1)] or [w])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(linked):
    label = np.arange(len(linked))
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            return label
        label = new


def test_simhash_tables(spark, sf, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 2)  # groups of three are split already
    for rows in (ODD, [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang", "source").collect()]):
        got = simhash.classes(docs(spark, rows)).collect()
        assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, format(slow_fingerprint(t), "016x")) for i, t, *_ in rows)
        known = [(i, slow_fingerprint(t)) for i, t, *_ in rows if i is not None]
        fp = np.array([f for _, f in known], dtype=np.uint64)
        ids = np.array([i for i, _ in known])
        linked = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2) | (ids[:, None] == ids[None, :])
        order = np.argsort(ids, kind="stable")
        label = closure(linked[order][:, order])
        want = {int(ids[order][k]): int(ids[order][label[k]]) for k in range(len(ids))}
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(r.component_id is None for r in got if r.doc_id is None)
    assert simhash.classes(docs(spark, [])).count() == 0


def test_representatives_keep_clean_rows(spark):
    rows = [(k, prose(k % 10, 300), "en", "a") for k in range(40)] + [(100, prose(3, 300).replace("owls", "birds", 1), "en", "a"), (None, "free", None, None)]
    kept = simhash.representatives(docs(spark, rows), families=6, limit=4, keep=2)
    assert kept.columns == docs(spark, []).columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted([str(k) for k in range(10)] + ["None"])


def test_long_chains_join(spark):
    chain = spark.createDataFrame([(k + 1, k) for k in range(300)] + [(1001, 1000)], "a long, b long")
    got = {r.node: r.component for r in simhash.components(chain).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
    drawn = simhash.drawn_in(chain)
    assert {r.node: r.component for r in simhash.components(drawn).collect()} == got


# --- suffix arrays --------------------------------------------------------------------------------------------------


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(60):
        text = rng.integers(1, [2, 3, 6, 200][trial % 4] + 1, size=int(rng.integers(2, 400))).astype(np.uint8)
        if trial % 3 == 0:
            text = np.concatenate((text, text[: len(text) // 2], text))
        text[rng.integers(0, len(text) - 1, size=3)] = 0
        text[-1] = 1
        text = np.append(text, np.uint8(0))
        pos, lcp = induced.suffix_order(text, limit=[0, 500, 1 << 30][trial % 3])
        raw = text.tobytes() + b"\0" * 80
        keys = [raw[p : p + induced.DEPTH] for p in pos.tolist()]
        assert keys == sorted(keys) and sorted(pos.tolist()) == list(range(len(text) - 1))
        for a, b, n in zip(keys, keys[1:], lcp[1:].tolist(), strict=False):
            same = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
            assert min(same, 50) == min(n, 50)


def slow_removals(rows):
    first: dict = {}
    key = lambda i: math.inf if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(key(i), first.get(b[p : p + 50], math.inf))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i, len(b), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(int)) == 1)), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_a_shard_is_judged_in_narrow_arrays():
    """At most 50 bytes of memory for each byte of a shard's texts."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, 4000, dtype=np.uint8).tobytes() for _ in range(300)]
    rows = []
    for k in range(0, 300, 100):
        ids = np.arange(k, k + 100).astype("<i8").tobytes()
        rows.append({"batch": k, "texts": suffix_dedup.squeeze(b"".join(texts[k : k + 100])), "sizes": np.full(100, 4000, "<i4").tobytes(), "low": ids, "high": ids})
    tracemalloc.start()
    told = suffix_dedup.judge((0,), pd.DataFrame(rows)).told
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * 300 * 4000
    assert not any(suffix_dedup.expand(x) for x in told)


def test_passages_of_earlier_documents_go(spark, sf, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PER_SHARD", 60_000)
    real = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang", "source").collect()]
    shared = "This passage of well over fifty bytes stands in several documents, word for word. " * 2
    made = [(500 + k, prose(k, 40) + shared + prose(k + 9, 20), "en", "a") for k in range(6)] + [(700, "ab" * 200, "en", "a"), (701, "ab" * 90, "en", "a"), (702, "é" * 80, "fr", "b"), (703, "xé" + "é" * 60, "fr", "b")]
    for rows, size, crowd in ((ODD + made, 2000, suffix_dedup.CROWD), (ODD + made, 2000, 2), (real, 30_000, 1)):
        monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
        d = docs(spark, rows)
        out = suffix_dedup.removals(d, batch_bytes=size, carry=("lang", "row", "id"))
        got = Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect())
        assert got == slow_removals([(i, t) for i, t, *_ in rows])
    cut = suffix_dedup.deduplicated(docs(spark, made))
    assert cut.columns == docs(spark, []).columns
    texts = {r.doc_id: r for r in cut.collect()}
    assert shared.strip() in texts[500].text and shared.strip() not in texts[503].text and texts[503].lang == "en" and texts[503].row == "r"
    assert suffix_dedup.digests(docs(spark, [])).count() == 0


def test_a_common_line_loads_no_shard(monkeypatch):
    """Twice the documents that share a line, in other surroundings each: pieces of its hash become strings in many shards."""
    line = b"One common line of eighty-eight bytes stands in every document, in other surroundings. "
    for n in (200, 400):
        texts = [f"{k * 7919:>60}".encode() + line + f"{k * 104729:<60}".encode() for k in range(n)]
        make = lambda: suffix_dedup.Batch(np.arange(n, dtype="<i8").tobytes(), np.array(list(map(len, texts)), "<i8").tobytes(), suffix_dedup.squeeze(b"".join(texts)), 16)
        told = list(make().hashes())
        flags = [(s, np.full(len(v) // 4, 255, dtype=np.uint8)[: -(-len(v) // 32)].tobytes(), crowds) for s, v, _, crowds in ((s, v, x, np.frombuffer(m, "<i4").reshape(2, -1)[0][np.frombuffer(m, "<i4").reshape(2, -1)[1] > 50].astype("<i4").tobytes()) for s, v, x, m in told)]
        batch = make()
        batch.shared(flags)
        load = [sum(map(len, x)) for x in batch.texts.values()]
        assert max(load) < 3 * np.median(load)
        plain = make()
        plain.shared([(s, b, b"") for s, b, _ in flags])
        load = [sum(map(len, x)) for x in plain.texts.values()]
        assert max(load) > 3 * np.median(load)


def test_batches_grow_with_the_corpus(spark, monkeypatch):
    """Each batch has a message for each shard, so their number must not grow with the square of the corpus."""
    limits, pack = [], suffix_dedup.batches
    monkeypatch.setattr(suffix_dedup, "batches", lambda *a: limits.append(a[-1]) or pack(*a))
    for name, value in (("BATCH", 1000), ("BATCHES", 4), ("LARGEST", 20_000), ("PER_SHARD", 5000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    for n, least, most in ((1, 1000, 1000), (60, 1001, 19_999), (400, 20_000, 20_000)):
        rows = [(k, prose(k % 50, 40), "en", "a") for k in range(n)]
        out = suffix_dedup.removals(docs(spark, rows))
        got = Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect())
        assert got == slow_removals([(i, t) for i, t, *_ in rows]) and least <= limits[-1] <= most


def test_messages_of_a_shard_are_told_together(monkeypatch):
    texts = [[(prose(k % 4, 30) + prose(k + j, 20)).encode() for j in range(6)] for k in range(30)] + [[], [b"x" * 5000]]
    rows = [{"batch": k, "texts": suffix_dedup.squeeze(b"".join(t)), "sizes": np.array(list(map(len, t)), "<i4").tobytes(), "low": (np.arange(len(t)) + 9 * k).astype("<i8").tobytes(), "high": (np.arange(len(t)) + 9 * k + 3).astype("<i8").tobytes()} for k, t in enumerate(texts)]
    found = []
    for n in (1, 3000, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "AT_ONCE", n)
        found.append([suffix_dedup.expand(x) for x in suffix_dedup.judge((0,), pd.DataFrame(rows)).told])
    assert found[0] == found[1] == found[2] and any(found[0]) and list(suffix_dedup.together([5, 1 << 21, 3, 4])) == [(0, 1), (1, 2), (2, 4)]


def test_strings_of_one_hash_are_held_apart(monkeypatch):
    text = (prose(1, 60) + prose(2, 40) + prose(1, 60)).encode()
    batch = suffix_dedup.Batch(np.zeros(1, "<i8").tobytes(), np.array([len(text)], "<i8").tobytes(), suffix_dedup.squeeze(text), 3)
    at = np.random.default_rng(1).permutation(len(text) - 49)
    for hashed in (suffix_dedup.mixed, lambda x: x & np.uint64(3)):
        monkeypatch.setattr(suffix_dedup, "mixed", hashed)
        own, label, first = batch.strings(at)
        strings = [text[k : k + 50] for k in at.tolist()]
        assert len(first) == len(set(strings)) < len(at) and [strings[k] for k in first[label]] == strings
        assert len(set(zip(own.tolist(), strings, strict=True))) == len(set(strings))


def test_largest_string_of_a_shard_meets_its_equals(spark):
    """The largest string ends two different pieces, and a larger suffix that is too short to be a string follows it."""
    largest = "z" + "".join(chr(97 + k * 7 % 25) for k in range(47)) + "zz"
    rows = [(1, "".join(chr(97 + k * 11 % 25) for k in range(9)) + largest, "en", "a"), (2, "".join(chr(97 + k * 3 % 25) for k in range(9)) + largest, "en", "a")]
    texts = [t.encode() for _, t, *_ in rows]
    pdf = pd.DataFrame({"batch": [0, 1], "texts": [suffix_dedup.squeeze(t) for t in texts], "sizes": [np.array([len(t)], "<i4").tobytes() for t in texts], "low": [np.array([i], "<i8").tobytes() for i in (1, 2)], "high": [np.array([i], "<i8").tobytes() for i in (1, 2)]})
    told = {r.batch: np.frombuffer(suffix_dedup.expand(r.told), "<i8").reshape(4, -1).T.tolist() for r in suffix_dedup.judge((0,), pdf).itertuples()}
    assert told[1] == [[0, 9, 1, 1]]
    out = suffix_dedup.removals(docs(spark, rows)).collect()
    got = Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out)
    assert got == slow_removals([(i, t) for i, t, *_ in rows])


# --- Kneser-Ney -----------------------------------------------------------------------------------------------------


def slow_perplexities(train, ask):
    n = kneser_ney.ORDER
    pad = lambda t: b"\2" * (n - 1) + t + b"\3"
    c = {n: Counter(pad(t)[k : k + n] for t in train for k in range(len(t) + 1))}
    for m in range(n - 1, 0, -1):
        c[m] = Counter(g[1:] for g in c[m + 1])
    d = {m: kneser_ney.discounts([Counter(c[m].values())[k] for k in (1, 2, 3, 4)]) for m in c}
    context = {m: defaultdict(lambda: [0, 0.0]) for m in c}
    for m in c:
        for g, k in c[m].items():
            x = context[m][g[:-1]]
            x[0], x[1] = x[0] + k, x[1] + d[m][min(k, 3) - 1]

    def p(g):
        if not g:
            return kneser_ney.FLOOR
        x = context[len(g)].get(g[:-1])
        low = p(g[1:])
        k = c[len(g)].get(g, 0)
        return ((k - d[len(g)][min(k, 3) - 1] if k else 0) + x[1] * low) / x[0] if x else low

    return [math.exp(-sum(math.log(p(pad(t)[k : k + n])) for k in range(len(t) + 1)) / (len(t) + 1)) for t in ask]


def test_perplexities_equal_brute_force(spark):
    rows = [(k, prose(k, 30) if k % 4 else "%$# !! " * 20, "en" if k % 3 else "de", "a") for k in range(60)] + [(100, None, "en", "a"), (101, "", None, "a"), (102, "zz zz", "fr", "a"), (None, "free", "en", "a")]
    y = labels(spark, [(k, int(k % 4 != 0), 0) for k in range(60)] + [(None, 1, 0), (7, None, 0)])
    d = docs(spark, rows)
    held = {r.id: r.held for r in kneser_ney.trusted_ids(y).collect()}
    got = kneser_ney.perplexities(d, y).collect()
    assert len(got) == len(rows) and 7 not in held
    for lang in ("en", "de", "fr", ""):
        mine = [r for r in got if r.lang == lang]
        train = [t.encode() for i, t, x, _ in rows if (x or "") == lang and held.get(i) is False]
        text = {i: (t or "").encode() for i, t, *_ in rows}
        want = slow_perplexities(train, [text[r.id] for r in mine])
        assert np.allclose([r.perplexity for r in mine], want, rtol=1e-5)
        assert all(r.n_symbols == len(text[r.id]) + 1 for r in mine)
    assert kneser_ney.quality(docs(spark, []), labels(spark, [])).count() == 0


def test_quantiles_split_junk_from_prose(spark, sf):
    d, y = table(spark, sf.replace("sf0.001", "sf0.01"), "documents"), table(spark, sf.replace("sf0.001", "sf0.01"), "labels")
    got = {r.doc_id: r for r in kneser_ney.quality(d, y).collect()}
    marks = {r.doc_id: r.quality for r in y.collect()}
    good = [got[i].keep for i, q in marks.items() if q == 1]
    bad = [got[i].keep for i, q in marks.items() if q == 0]
    assert len(got) == d.count() and np.mean(good) > 0.95 and np.mean(bad) < 0.5
    held = {r.id for r in kneser_ney.trusted_ids(y).filter("held").collect()}
    for lang in {r.lang for r in got.values()}:
        own = sorted(r.perplexity for i, r in got.items() if r.lang == lang and i in held)
        bars = {r.threshold for r in got.values() if r.lang == lang}
        if not own:
            assert bars == {None} and all(r.keep for r in got.values() if r.lang == lang)
            continue
        want = own[math.ceil(kneser_ney.QUANTILE * len(own)) - 1]
        assert len(bars) == 1 and want <= bars.pop() * (1 + 1e-9) <= want * math.exp(1.1 * kneser_ney.STEP)
