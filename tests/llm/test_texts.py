"""Text operators: scores, rules, chat trees, mixes and the pipeline, against plain loops."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from curaspark.llm import bilinear_lm, line_quality, reply_trees, source_mix, toxicity

FOLDER = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ toxicity


def test_grammar_marks_negation_report_and_target():
    machine = toxicity.grammar()
    assert machine.run(["g", "o", "i"])[-1] == "i@"
    assert machine.run(["n", "o", "i"])[-1] == "i-"
    assert machine.run(["r", "o", "o", "i"])[-1] == "ir"
    assert machine.run(["g", "r", "n", "t"])[-1] == "t-r@"
    assert machine.run(["n", "o", "o", "o", "i"])[-1] == "i"
    assert machine.run(["r", "o", "q", "i"])[-1] == "i"


def test_composition_equals_running_one_after_another():
    rng = random.Random(1)
    a = toxicity.scope("n", 3, "-", toxicity.ALPHABET)
    after = (*toxicity.ALPHABET, *(k + "-" for k in toxicity.KINDS))
    b = toxicity.scope("r", 8, "r", after)
    for _ in range(200):
        symbols = [rng.choice(toxicity.ALPHABET) for _ in range(rng.randint(0, 20))]
        assert a.then(b).run(symbols) == b.run(a.run(symbols))


def test_toxicity_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = toxicity.scores(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter(toxicity.held_out("doc_id"))
    rows = scored.filter("toxic is not null").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.93 * len(rows)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "you idiot", 1), (4, "word " * 30_000, 1), (5, "YOU IDIOT!", 2)], "doc_id bigint, text string, score int")
    none = spark.createDataFrame([(1, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, none)
    got = toxicity.scores(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and by[1].score == by[2].score < 0.3 and by[5].predicted == 1
    assert sorted(r.doc_id for r in toxicity.accepted(docs, model).collect()) == [1, 2, 4]


# ------------------------------------------------------------------ quality


def test_line_rules():
    prose = "The cat sat on the mat and looked at the other cat for a while."
    assert line_quality.line_fails(prose, prose.encode().split(), False) is None
    for line, rule in [
        ("Home | About | News | Contact", "navigation"), ("BUY THIS NOW!!", "shouting"), ("a%%% b&&& c***", "symbols"),
        ("Please enable cookies.", "boilerplate"), ("so so so so so so so so", "stutter"), (" ".join(["word%d" % i for i in range(15)]), "unclosed"),
    ]:
        assert line_quality.line_fails(line, line.encode().split(), False) == rule
    assert line_quality.line_fails(prose, prose.encode().split(), True) == "repeated"


def test_quality_counts(spark):
    rng = random.Random(9)
    texts = [None, "", "\n \n", "a b c a b c", "x\ny\nx\n\n\nx", "é# |<> \x0b 中 文"]
    texts += ["\n".join(" ".join(rng.choice("ab c d# Éa".split(" ")) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 20))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, kept int")
    for r in line_quality.verdicts(docs).collect():
        t = texts[r.doc_id] or ""
        words = [w.decode() for w in t.encode().split()]
        lines = [x for x in t.split("\n") if x.encode().split()]
        three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        many = Counter(three)
        inside = {i + j for i, w in enumerate(three) if many[w] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (r.kept and r.base_failed)


# ------------------------------------------------------------------ conversations


def test_escaping_round_trip():
    rng = random.Random(2)
    bits = [*reply_trees.CONTROLS, "\\", "\\\\", "n", "\n", "<", "|", "s>", "[", "INST]", "é", ""]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        escaped = reply_trees.escape(text)
        assert reply_trees.unescape(escaped) == text and not any(c in escaped for c in reply_trees.CONTROLS)
        assert reply_trees.unescape(reply_trees.escape_role(text)) == text and "\n" not in reply_trees.escape_role(text)


def test_tree_paths(spark):
    rng = random.Random(3)
    rows = []
    for tree in (1, 2):
        for i in range(60):
            parent = None if i == 0 else rng.randrange(max(0, i - 5), i)
            rows.append((tree, i, parent, rng.choice(["user", "assistant", None]), rng.choice(["a", "</s>", None, "x\ny"]), rng.random()))
    rows += [(3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (4, 7, 99, "user", "orphan", None), (None, 1, None, "user", "x", 1.0), (5, 1, 1, "assistant", "self", 0.0)]
    messages = spark.createDataFrame(rows, "tree bigint, id bigint, parent bigint, role string, text string, score double")
    known = {(t, i): (p, r or "", x or "", s or 0.0) for t, i, p, r, x, s in rows if t in (1, 2)}
    got = reply_trees.conversations(messages, branches=3).collect()
    for tree in (1, 2):
        parents = {(t, p) for (t, _), (p, *_) in known.items()}
        paths = []
        for t, i in known:
            if t == tree and (t, i) not in parents:
                path, at = [], i
                while at is not None:
                    path.append(at)
                    at = known[t, at][0]
                paths.append((-sum(known[t, k][3] for k in reversed(path)), i, path[::-1]))
        paths.sort(key=lambda p: (round(p[0], 9), p[1]))
        mine = sorted((r for r in got if r.tree == tree), key=lambda r: r.rank)
        assert [r.leaf for r in mine] == [p[1] for p in paths[:3]]
        for r, p in zip(mine, paths):
            turns = [known[tree, k][1:3] for k in p[2]]
            assert reply_trees.parse(r.formatted) == turns
            learnt = [reply_trees.unescape(r.formatted[s.start : s.stop]) for s in r.spans]
            assert learnt == [x for role, x in turns if role == "assistant"]
    assert sorted(r.tree for r in got if r.tree > 2) == [4, 5]


def test_conversation_query(spark):
    rows = [(1, 0, "user", "hi", 1), (1, 1, "assistant", "a<s>", 1), (1, 1, "assistant", "a<s>", 1), (2, None, None, None, 1), (None, 0, "user", "x", 1)]
    rows += [(3, i, "assistant" if i % 2 else "user", f"t{i}", 1) for i in range(300)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, tree int").drop("tree")
    messages = reply_trees.chains(table, "conv_id", ["turn"])
    got = {r.tree: r for r in reply_trees.read_back(reply_trees.conversations(messages)).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].n_turns == 3 and got[1].loss_chars == 8
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\na<s>\nassistant\na<s>\n").hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"a<s>a<s>").hexdigest()
    assert got[2].n_turns == 1 and got[3].n_turns == 300


# ------------------------------------------------------------------ mixing


def _filled(sizes: dict) -> dict:
    total, open_ = sum(sizes.values()), dict(zip(sorted(sizes, key=lambda s: (s is None, (s or "").encode())), [5, 2, 1] * len(sizes)))
    done: dict = {}
    while open_:
        level = (total - sum(done.values())) / sum(open_.values())
        over = [s for s in open_ if 3 * sizes[s] < level * open_[s]]
        if not over:
            return done | {s: level * w for s, w in open_.items()}
        for s in over:
            done[s] = 3 * sizes[s]
            del open_[s]
    return done


def test_mix_meets_targets(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "é", "z", "Z", None, "tiny"] if i % 50 else ["tiny"]), 1) for i in range(3000)]
    rows = [r for r in rows if r[2] != "tiny" or r[0] < 400] + [(5000, None, "only empty", 1), rows[1], (None, "x y", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    got = source_mix.mix_table(docs, block_words=500).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = _filled(dict(sizes))
    of = {r[0]: r[2] for r in rows}
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[of[r.doc_id]] and abs(r.target - want[of[r.doc_id]]) < 1e-6 * (1 + r.target)
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    again = source_mix.mix_table(docs.repartition(5), block_words=500).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = source_mix.mixed(docs, block_words=500, shard_words=2000)
    assert out.columns == docs.columns
    assert out.select(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != "")))).first()[0] == sum(taken.values())


@pytest.mark.parametrize("block", [20_000, 500])
def test_long_documents_do_not_keep_a_mix_from_its_target(spark, block):
    rows = [(s * 100 + i, "w " * (8000 if i == 40 else 300), f"s{s:02}") for s in range(30) for i in range(41)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken, target = Counter(), {}
    for r in source_mix.mix_table(docs, weights=(3, 1, 2), block_words=block).collect():
        taken[r.doc_id // 100] += r.taken
        target[r.doc_id // 100] = r.target
    # half of the words of every third source are wanted; documents of 300 words are left for the remainder
    assert all(abs(taken[s] - t) <= 150 for s, t in target.items())
    out = source_mix.mixed(docs, weights=(3, 1, 2), block_words=block)
    assert out.select(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] == sum(taken.values())


def test_splitting_tree_is_exact():
    quotas = np.array([100, 37, 0, 5])
    leaves = [source_mix.split_path(quotas, s, 7) for s in range(7)]
    assert (sum(n for _, n in leaves) == quotas).all()
    at = np.zeros(4, int)
    for start, n in leaves:
        assert (start == at).all()
        at = at + n
    assert max(n.sum() for _, n in leaves) - min(n.sum() for _, n in leaves) <= 2


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert source_mix.mix_table(docs).count() == 0


# ------------------------------------------------------------------ language model


def test_language_model(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_001, None), (10_002, ""), (None, "the of"), (10_001, None)], "doc_id bigint, text string")
    docs = docs.unionByName(extra)
    rows = docs.collect()
    got = bilinear_lm.scores(docs).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    texts = {(r.doc_id): [*(r.text or "").encode().lower().split(), None] for r in rows}
    counts = Counter(w for r in rows if not held(r.doc_id) for w in texts[r.doc_id])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in texts[r.doc_id])
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.train_tokens == n and r.held_out == held(r.doc_id)
        assert r.n_tokens == len(texts[r.doc_id]) and r.n_known == sum(counts[w] > 0 for w in texts[r.doc_id])
        assert r.score < 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_model_is_normalised():
    shape = bilinear_lm.Shape.of(100_000, 5000)
    model = bilinear_lm.Model.fresh(shape, np.full(shape.outputs, 1 / shape.outputs))
    c1, c2, q, bias = model.tables
    for a, b in [(0, 0), (7, 40), (shape.end, shape.near)]:
        raw = q @ (c1[a] + c2[b]) + bias
        assert abs(np.exp(raw - bilinear_lm.log_sums(model, np.array([a]))[0, b]).sum() - 1) < 1e-4


def test_model_grows_with_the_tokens():
    small, large = bilinear_lm.Shape.of(10**6, 10**6), bilinear_lm.Shape.of(10**9, 10**9)
    assert large.words == 10 * small.words and large.near > small.near and large.frequent > small.frequent
    assert bilinear_lm.Shape.of(0, 0).outputs == 1 + bilinear_lm.CLASSES


def test_language_model_scores_by_a_plain_loop(spark, monkeypatch):
    """Every token's probability: softmax over all outputs, then the word's smoothed share of its class."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source").withColumn("held", F.lit("clash"))
    kept = {}

    def spy(codes, shape, listed, unigram, training):
        kept["shape"], kept["state"] = shape, real(codes, shape, listed, unigram, training)
        return kept["state"]

    real = bilinear_lm.train
    monkeypatch.setattr(bilinear_lm, "train", spy)
    monkeypatch.setattr(bilinear_lm, "Shape", type("Small", (bilinear_lm.Shape,), {"of": classmethod(lambda cls, t, v: cls(300, 9, 700))}))
    got = {r.doc_id: r for r in bilinear_lm.scores(docs).collect()}
    shape = kept["shape"]
    rows = docs.collect()
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in rows}
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    number = {w: n for n, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: shape.words])}
    size = sum(int(np.prod(t)) for t in shape.tables)
    c1, c2, q, bias = bilinear_lm.Model.unpacked(kept["state"][:size], shape).tables
    members = {}
    for w, n in counts.items():
        if w not in number:
            members.setdefault(bilinear_lm.word_class(w), []).append(n)

    def output(word):
        if word is None:
            return shape.end
        return number.get(word, shape.words + 1 + bilinear_lm.word_class(word))

    def second(word):
        if word is None:
            return shape.near
        return number[word] if number.get(word, shape.near) < shape.near else shape.near + 1 + bilinear_lm.word_class(word) % bilinear_lm.NEAR_CLASSES

    for i in sorted(texts)[:25]:
        words, total = [None, None, *texts[i], None], 0.0
        for n in range(2, len(words)):
            raw = (q @ (c1[output(words[n - 1])] + c2[second(words[n - 2])]) + bias).astype(float)
            out = output(words[n])
            total += (raw[out] - raw.max() - math.log(np.exp(raw - raw.max()).sum())) / math.log(10)
            if out > shape.end:
                ns = members.get(out - shape.end - 1, [])
                total += math.log10((counts[words[n]] + 0.1) / (sum(ns) + 0.1 * (len(ns) + 1)))
        assert abs(got[i].score - total) < 1e-3 * abs(total)


def test_language_model_of_any_layout(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    totals = []
    for parts in (1, 40):
        rows = bilinear_lm.scores(docs.repartition(parts)).filter("held_out").collect()
        totals.append(sum(r.score for r in rows))
        assert totals[-1] > sum(r.base_score for r in rows)
    assert abs(totals[0] - totals[1]) < 0.02 * abs(totals[0])


def test_language_model_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bilinear_lm.scores(empty).collect() == []
    rows = [(1, None), (2, ""), (None, None), (3, "a b " * 20_000), (3, "a b " * 20_000), (10, " \t ")]
    got = bilinear_lm.scores(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2))).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 1, 40_001, 40_001] and all(r.score < 0 for r in got)
    nothing = bilinear_lm.scores(spark.createDataFrame([(1, None), (None, "")], "doc_id bigint, text string")).collect()
    assert all(r.n_tokens == 1 and r.n_known == 1 and r.train_tokens == 2 for r in nothing)


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
        if name in ("toxicity", "near duplicates"):
            assert docs.join(before, "doc_id", "left_anti").count() == 0 and docs.count() <= before.count()
        if name == "repeated passages":
            assert docs.count() == before.count()
    assert docs.count() == before.count() and docs.columns[0] == "doc_id"


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_of_nothing(spark, k):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, docs, FOLDER).count() == 0
