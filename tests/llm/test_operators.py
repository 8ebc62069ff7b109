"""Operators against brute force, on rows with nulls, repeats, ties, empty and long texts and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, starts string, _of string, mix_size string, n long, node string"
words_of = re.compile(rb"[^\x20\x09-\x0D]+").findall


def corpus() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(70), prose(120)
    texts = [None, "", " \t\n ", "a", "one two", "x " * 500, "é" * 400, prose(8000), base, base, base.upper()]
    for k in range(6):
        words = base.split()
        words[7 * k + 3] = f"edit{k}"
        texts.append(" ".join(words))
    texts += [prose(rng.randint(5, 60)) + " " + passage + "\n" + prose(rng.randint(5, 60)) for _ in range(5)]
    texts += [prose(rng.randint(1, 200)) for _ in range(15)] + ["Tail  spaces  ", "same line\nsame line\nother\n\nsame line"]
    rows = [(i, t, "en", ["src0", "src0", "b", None, "ä"][i % 5]) for i, t in enumerate(texts)]
    rows += [rows[8], rows[12], (None, base, "en", "b"), (None, None, None, None), (3, prose(30), "en", "b")]
    return [(*r, None if r[1] is None else len(r[1]), 1, "s", "o", "m", 2, "n") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(frame) -> collections.Counter:
    return collections.Counter(tuple(r) for r in frame.collect())


def raw(rows):
    return [(r[0], (r[1] or "").encode()) for r in rows]


def judged_rows(rows) -> list[tuple]:
    """The base metrics and verdict of each row."""
    out = []
    for i, b in raw(rows):
        w, text = words_of(b), b.decode()
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in text.split("\n") if words_of(x.encode())]
        out.append((i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)))
    return out


def brute_hosts(rows: list[tuple]) -> tuple:
    """The prior, the limit, and each host's shrunk rate with its low end, from (host, failed)."""
    n, k = collections.Counter(h for h, _ in rows), collections.Counter(h for h, failed in rows if failed)
    total, mean = len(rows), sum(k.values()) / len(rows)
    noise = mean * (1 - mean)
    spread = sum(n[h] * (k[h] / n[h] - mean) ** 2 for h in n) - noise * (len(n) - 1)
    room = noise * (total - sum(x * x for x in n.values()) / total - (len(n) - 1))
    share = min(max(spread / room, 1 / (total + 1)), 0.999) if room > 0 else 1 / (total + 1)
    a, b = (max(x * (1 / share - 1), 1e-9) for x in (mean, 1 - mean))
    var = lambda a, b: a * b / ((a + b) ** 2 * (a + b + 1))
    hosts = {h: ((x := k[h] + a) / (total_h := n[h] + a + b), x / total_h - 2 * var(x, total_h - x) ** 0.5) for h in n}
    return (a, b), min(0.5, a / (a + b) + 2 * var(a, b) ** 0.5), hosts


def test_quality_rules(docs, rows, empty):
    from vellum.llm.quality_rules import quality_rules

    want = collections.Counter(judged_rows(rows))
    found = quality_rules(docs)
    assert bag(found.drop("kept", "host_failure", "host_low", "host_kept")) == want
    prior, limit, hosts = brute_hosts([(r[3], f[-1]) for r, f in zip(rows, judged_rows(rows))])
    source = collections.defaultdict(set)
    for r in rows:
        source[r[0]].add(r[3])
    for r in found.collect():
        assert r.kept == (not r.base_failed and r.host_kept) and r.host_kept == (r.host_low <= limit)
        assert any(abs(r.host_failure - hosts[h][0]) < 1e-9 and abs(r.host_low - hosts[h][1]) < 1e-9 for h in source[r.doc_id])
    assert quality_rules(empty).count() == 0


def test_hosts_are_rejected(spark):
    from vellum.llm.quality_rules import quality_rules

    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 20 else "bad", "good") for i in range(200)] + [(1000 + i, "bad" if i % 20 else good, "bad") for i in range(200)] + [(5000, "bad", "new")]
    kept = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept[1] and not kept[0] and not kept[1000] and not kept[1001]


def test_unusual_host_among_many(spark):
    """A host that fails four times as often as the thirty others goes, though far from the absolute limit; without it none does."""
    from vellum.llm.quality_rules import quality_rules

    good, rng = " ".join(f"w{i}" for i in range(40)), random.Random(4)
    rows = [(h * 1000 + i, "bad" if rng.random() < 0.08 else good, f"h{h}") for h in range(30) for i in range(120)]
    odd = [(90_000 + i, "bad" if i % 10 < 4 else good, "odd") for i in range(400)]
    schema = "doc_id long, text string, source string"
    gone = quality_rules(spark.createDataFrame(rows + odd, schema)).where("not host_kept and not base_failed").collect()
    assert len(gone) == 240 and all(r.doc_id >= 90_000 for r in gone)
    assert quality_rules(spark.createDataFrame(rows, schema)).where("not host_kept").isEmpty()


def test_token_counts_and_cache(docs, rows, empty, tmp_path, spark):
    import sentencepiece

    from vellum.llm.registry import vocabulary
    from vellum.llm.token_counts import count_tokens

    path, cache = vocabulary("piece_bpe_32k.model"), str(tmp_path / "cache")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = collections.Counter((i, len(b), n := len(lib.encode(b.decode())), n > 4096) for i, b in raw(rows))
    assert bag(count_tokens(docs, path, cache)) == want
    stored = spark.read.parquet(cache).count()
    assert bag(count_tokens(docs, path, cache)) == want and spark.read.parquet(cache).count() == stored
    assert count_tokens(empty, path, cache).count() == 0


def test_tokenizers_word_by_word():
    import sentencepiece
    import struct

    from tokenizers import Tokenizer

    from vellum.llm.registry import vocabulary
    from vellum.llm.tokenizing import PieceCounts, WordIds

    texts = ["", " ", "a ", " a", "a  b", "\n", "\na", "a\n", "a \nb", "a\n b", "a\n\nb", "<|endoftext|>", "x<|endoftext|>y <s> </s> <unk>", "It's 'tis don'tre", "İstanbul ΣΑΣ Σ", "e ́ é", "日本語 ½", "a\tb\x0bc\x1cd\x85e", "▁x y▁", "\0a", "ſ K Å", "😀😀 ok", "a\r\nb", "%%'s!!"]
    lib, mine = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), WordIds(vocabulary("word_bpe_49k.json"), 5, 5)
    for t in texts * 2:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert mine.ids(t.encode()) == struct.pack(f"<{len(ids)}I", *ids), t
    sp, counts = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model")), PieceCounts(vocabulary("piece_bpe_32k.model"), 5)
    assert [counts.count(t.encode()) for t in texts] == [len(sp.encode(t)) for t in texts]


def test_mixing(docs, rows, empty):
    from vellum.llm.mixing import mix, mix_report

    found = mix_report(docs).collect()
    assert len(found) == len(rows)
    assert bag(mix_report(docs)) == collections.Counter(tuple(r) for r in found)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words_of((r[1] or "").encode()))
    total, order = 1.5 * sum(sizes.values()), sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: 2 * sizes[s] if s in full else weight[s] * level for s in order}
    got = collections.defaultdict(set)
    for r in found:
        got[r.source_size].add(round(r.target, 6))
        assert r.taken in (0, r.size, 2 * r.size)
    assert got == {sizes[s]: {round(target[s], 6)} for s in order}
    many = bag(mix(docs))
    assert set(many) <= {tuple(r) for r in rows} and mix(docs).columns == docs.columns
    assert sum(len(words_of((r[1] or "").encode())) * n for r, n in many.items()) == sum(r.taken for r in found)
    assert mix_report(empty).count() == 0 and mix(empty).count() == 0


def test_mixing_comes_near(spark):
    from vellum.llm.mixing import mix_report

    frame = spark.range(20_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('s', id % 40) end as source", "repeat('w ', cast(1 + id % 50 as int)) as text")
    found = mix_report(frame).join(frame.select("doc_id", "source"), "doc_id").groupBy("source", "target").agg({"taken": "sum"}).collect()
    assert len(found) == 41 and all(abs(r["sum(taken)"] - r.target) <= 50 for r in found)


def brute_suffixes(rows) -> tuple[collections.Counter, list]:
    """What suffix_dedup gives, and the text that without_repeats leaves of each row."""
    seen = collections.Counter(b[p : p + 200] for _, b in raw(rows) for p in range(len(b) - 199))
    want, texts = collections.Counter(), []
    for i, b in raw(rows):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[(i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
        at = 0
        kept = []
        for ch in b.decode():
            size = len(ch.encode())
            if not gone[at : at + size].all():
                kept.append(ch)
            at += size
        texts.append((i, "".join(kept)))
    return want, texts


@pytest.mark.parametrize("group", [20_000, 2])
def test_suffix_dedup(docs, rows, empty, group):
    """With a group of 2 the windows of most cores are counted one by one."""
    from vellum.llm.suffix_dedup import suffix_dedup, without_repeats

    want, texts = brute_suffixes(rows)
    assert bag(suffix_dedup(docs, group)) == want
    left = without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    assert collections.Counter(texts) == collections.Counter((r.doc_id, r.text or "") for r in left.collect())
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in left.collect())
    assert suffix_dedup(empty).count() == 0


def test_suffix_arrays():
    """Classes of windows out of the two orders, against the windows' bytes."""
    from vellum.llm.suffix_dedup import BYTES, repeated_windows

    rng = np.random.default_rng(3)
    core = rng.integers(0, 3, 169, dtype=np.uint8)
    cut, many, lead = [], [], []
    for _ in range(400):
        first, last = sorted(rng.integers(0, 32, 2).tolist())  # windows from `last` to `first` bytes before the core
        before, after = rng.integers(0, 2, last, dtype=np.uint8), rng.integers(0, 2, 31 - first, dtype=np.uint8)
        before[: max(0, last - 6)] = 0
        after[6:] = 1
        cut.append(bytes(np.concatenate([before, core if rng.random() < 0.8 else core[::-1], after])))
        many.append(last - first + 1), lead.append(last)
    weight = np.where(rng.random(400) < 0.1, 2, 1)
    seen = collections.Counter()
    for c, n, w in zip(cut, many, weight):
        for j in range(n):
            seen[c[j : j + 200]] += w
    found = repeated_windows(BYTES, np.array(many), np.array(lead), weight, cut)
    assert [[seen[c[j : j + 200]] > 1 for j in range(n)] for c, n in zip(cut, many)] == [row[:n].tolist() for row, n in zip(found, many)]
    assert 0 < found.sum() < sum(many)


def test_repeats_in_very_long_texts(spark):
    """Texts beyond the million units that are parsed at a time, with repeats across the seam."""
    from vellum.llm.substring_index import substring_dedup
    from vellum.llm.suffix_dedup import suffix_dedup

    rng = random.Random(8)
    words = [f"{rng.randrange(10**6):x}" for _ in range(210_000)]
    long = " ".join(words)
    rows = [(1, long, "en", "a"), (2, long[1_048_300:1_048_900], "en", "a"), (3, " ".join(words[209_000:209_100]), "en", "a"), (4, "ab " * 400_000, "en", "a")]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert len(long) > 1 << 20
    assert bag(suffix_dedup(frame)) == brute_suffixes(rows)[0]
    assert bag(substring_dedup(frame)) == brute_substrings(rows)


def brute_substrings(rows) -> collections.Counter:
    first = {}
    split = [((1 << 63) - 1 if i is None else i, words_of(b)) for i, b in raw(rows)]
    for i, w in split:
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            first[k] = min(first.get(k, (i, p)), (i, p))
    want = collections.Counter()
    for (i, w), r in zip(split, rows):
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if (i, p) > first[tuple(w[p : p + 20])]:
                gone[p : p + 20] = [True] * 20
        want[(r[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())] += 1
    return want


@pytest.mark.parametrize("batches, max_runs, bits", [(1, 4, 64), (4, 2, 64), (3, 1, 9)])
def test_substring_index(docs, rows, empty, batches, max_runs, bits):
    """Hashes of 9 bits meet all the time: verification and what follows it must settle them."""
    from vellum.llm.substring_index import substring_dedup

    assert bag(substring_dedup(docs, batches, max_runs, bits)) == brute_substrings(rows)
    assert substring_dedup(empty, batches, max_runs, bits).count() == 0


@pytest.mark.parametrize("bits", [64, 9])
def test_substring_index_opens_again(spark, docs, rows, tmp_path, bits):
    """Batch after batch, each with the log as the last one left it; runs are compacted on the way, and hold each window once."""
    from vellum.llm.common import Scratch
    from vellum.llm.substring_index import FingerprintIndex, batches_of, cut, gathered, with_spans

    found = collections.Counter()
    for batch in batches_of(docs, 4):
        index = FingerprintIndex(spark, str(tmp_path / "log"), 3, 2, bits=bits)
        hits = index.add(batch)
        spans = gathered(index.repeats(batch, hits, docs, Scratch(spark, "again"), 2).distinct())
        index.compact_if_many()
        assert len(index.runs) <= 2
        found += bag(with_spans(batch, spans).select(batch["doc_id"], batch["text"].cast("binary").alias("text"), spans["starts"], spans["ends"]).where("text is not null").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string"))
    want = brute_substrings(rows)
    assert found - want == collections.Counter() and sum((want - found).values()) == sum(r[1] is None for r in rows)
    index = FingerprintIndex(spark, str(tmp_path / "log"))
    assert index.version == 5 and index.buckets == 3
    if bits == 64:
        windows = {tuple(w[p : p + 20]) for _, b in raw(rows) for w in [words_of(b)] for p in range(len(w) - 19)}
        assert sum(r.n for k in index.runs for r in index.table(k).collect()) == len(windows)


def brute_components(rows, k, percent):
    sets = []
    for i, b in raw(rows):
        w = b.lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for x in range(len(sets)):
        ids[find(x)].append(rows[x][0])
    least = {g: min((i for i in m if i is not None), default=None) for g, m in ids.items()}
    return [(rows[x][0], len(sets[x]), c := least[find(x)] if sets[x] else rows[x][0], rows[x][0] == c) for x in range(len(sets))]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, empty, k, percent):
    from vellum.llm.superminhash import keep_one, near_duplicates

    assert bag(near_duplicates(docs, k, percent).drop("text_key")) == collections.Counter(brute_components(rows, k, percent))
    assert near_duplicates(empty, k, percent).count() == 0
    assert set(bag(keep_one(docs, k, percent))) <= {tuple(r) for r in rows}


@pytest.mark.parametrize("large", [2048, 50])
def test_large_group_of_near_copies(spark, large):
    """In blocks alone, and after rounds of pairing."""
    from vellum.llm.superminhash import near_duplicates

    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(100)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, large=large).drop("text_key")
    assert bag(found) == collections.Counter(brute_components(rows, 3, 85))


def test_superminhash_estimates():
    from vellum.llm.superminhash import mix64, signature

    x = mix64(np.arange(1500, dtype=np.uint64))
    errors = [(signature(mix64(x[:1000] + np.uint64(s))) == signature(mix64(x[250:1250] + np.uint64(s)))).mean() - 0.6 for s in range(200)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    assert len(set(signature(x[:1]).tolist())) > 100 and (signature(x[:3]) < 1 << 63).all()


def brute_pieces(texts: list[tuple]) -> collections.Counter:
    """(doc_id, piece, start, length, crc32 of the ids) of (doc_id, text as bytes)."""
    import struct

    from tokenizers import Tokenizer

    from vellum.llm.registry import vocabulary

    lib, want = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), collections.Counter()
    for i, b in texts:
        ids = lib.encode(b.decode(), add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    return want


def check_sequences(found: list) -> None:
    by = collections.defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 2048


def test_packing(docs, rows, empty):
    from vellum.llm.packing import pack
    from vellum.llm.registry import vocabulary

    path = vocabulary("word_bpe_49k.json")
    found = pack(docs, path, pieces_per_packer=7)
    assert bag(found.drop("sequence_id", "offset")) == brute_pieces(raw(rows))
    check_sequences(found.collect())
    assert pack(empty, path).count() == 0


def test_full_pieces_leave_open_bins_alone():
    from vellum.llm.packing import BestFit

    fit = BestFit(100, 1)
    assert [fit.put(n) for n in (60, 100, 40)] == [(0, 0), (1, 0), (0, 60)] and fit.next == 2


def test_longest_first_meets_the_bound():
    from vellum.llm.packing import OPEN_BINS, BestFit

    rng, fit = random.Random(3), BestFit(2048, OPEN_BINS)
    lengths = sorted((min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000)), reverse=True)
    used = len({fit.put(n)[0] for n in lengths})
    assert used <= 1.002 * max(sum(lengths) / 2048, sum(n > 1024 for n in lengths)) + 1


def test_best_fit_is_tight():
    from vellum.llm.packing import BestFit

    rng, fit = random.Random(1), BestFit(2048, 64)
    lengths = [rng.randint(1, 900) for _ in range(5000)]
    bins = {fit.put(n)[0] for n in lengths}
    assert len(bins) <= 1.02 * sum(lengths) / 2048 + 64 and fit.open <= 64


def labelled(spark, toxic_words, n=1200):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    docs, labels = [(None, None), (-1, ""), (-2, "x " * 5000)], [(None, 1, 1), (0, None, None)]
    for i in range(n):
        toxic, good = i % 6 == 0, i % 5 != 0
        words = [rng.choice(vocabulary) for _ in range(60)]
        if toxic:
            words[::15] = rng.choices(toxic_words, k=4)
        docs.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def judged(found, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect() if r[column] is not None}
    got = [(r.predicted, truth[r.doc_id]) for r in found.collect() if r.held_out and r.doc_id in truth]
    return sum(p == t for p, t in got) / len(got)


def test_toxicity(spark):
    from vellum.llm.toxicity import drop_toxic, toxicity_scores, train

    docs, labels = labelled(spark, ["awful", "horrid", "vile"])
    found = toxicity_scores(docs, labels)
    assert found.count() == docs.count() and judged(found, labels, "toxic") > 0.95
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found.collect())
    kept = drop_toxic(docs, train(docs, labels))
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()
    none = toxicity_scores(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in none.collect()} == {0}
    assert toxicity_scores(docs.limit(0), labels.limit(0)).count() == 0


def test_risk_and_its_gradient():
    """The gradient against differences of the risk; where the bracket is negative, against the bracket's own, turned round."""
    from vellum.llm.toxicity import risk, sigmoid

    rng = np.random.default_rng(6)
    xp, xu = (rng.random((30, 5)) < 0.4).astype(np.float64), (rng.random((60, 5)) < 0.3).astype(np.float64)
    for w, b, prior, negative in ((rng.normal(size=5), -1.0, 0.2, False), (np.full(5, 0.5), 1.0, 0.95, True)):
        def bracket(w, b):
            return -np.log(1 - sigmoid(xu @ w + b)).mean() + prior * np.log(1 - sigmoid(xp @ w + b)).mean()

        def whole(w, b):
            return prior * -np.log(sigmoid(xp @ w + b)).mean() + bracket(w, b) + 0.05 * w @ w

        assert (bracket(w, b) < 0) == negative
        value, gradient = risk(xp, xu, w, b, prior, 0.1)
        assert abs(value - (whole(w, b) - min(0, bracket(w, b)))) < 1e-6
        goal = (lambda w, b: -bracket(w, b) + 0.05 * w @ w) if negative else whole
        for k in range(6):
            d = np.eye(6)[k] * 1e-5
            slope = (goal(w + d[:5], b + d[5]) - goal(w - d[:5], b - d[5])) / 2e-5
            assert abs(slope - gradient[k]) < 1e-4


def test_toxicity_scores_by_hand(spark):
    """Every score is the sigmoid of the base and the weights of the words and beginnings there, whatever the text."""
    from vellum.llm.toxicity import Model, drop_toxic, scored

    model = Model({"vile": 2.0, "^vile": 0.5, "^vilen": 1.0, "été": -1.0}, -1.5)
    texts = ["vile", "a VILE, vile thing", "vileness", "Été", "", None, "x " * 200_000 + "vile", "vil", "vile7"]
    sums = [1.0, 1.0, 0.0, -2.5, -1.5, -1.5, 1.0, -1.5, 1.0]
    rows = [(i, t, "c", 1.0) for i, t in enumerate(texts)] + [(0, "vile", "c", 1.0), (None, "vile", "c", 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `a b` string, score double")
    want = collections.Counter((i, round(1 / (1 + np.exp(-x)), 12)) for i, x in [*enumerate(sums), (0, 1.0), (None, 1.0)])
    assert collections.Counter((r.doc_id, round(r.score, 12)) for r in scored(frame, model).collect()) == want
    assert bag(drop_toxic(frame, model, 0.6)) == collections.Counter(r for r, x in zip(rows, [*sums, 1.0, 1.0]) if 1 / (1 + np.exp(-x)) < 0.6)


def test_samples_are_the_same_each_time(spark):
    from vellum.llm.labelled import sample_class, sample_unlabelled

    rows = [(i, f"text {i}") for i in range(500)] + [(7, "another"), (None, "none"), (8, "x" * 70_000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, toxic int")
    first = sample_class(docs, labels, "toxic", 1, 40, "s"), sample_unlabelled(docs, 40, "s")
    assert all(0 < len(x) <= 40 for x in first)
    assert first == (sample_class(docs.repartition(7, "text"), labels.repartition(5), "toxic", 1, 40, "s"), sample_unlabelled(docs.repartition(7, "text"), 40, "s"))


def test_compression_scores_by_hand(spark):
    """A score is the logistic curve of the compressed sizes under both dictionaries, recomputed here."""
    import math

    import zstandard

    from vellum.llm.compression_quality import Model, logistic, scored

    good, bad = b"the quick brown fox jumps over the lazy dog " * 20, b"BUY NOW!!! CHEAP $$$ " * 40
    weights = [30.0, 0.2, -1.0, 0.4]
    texts = ["the quick brown fox", "BUY NOW!!!", "", None, "é" * 90_000, "same", "same"]
    rows = [(i, t, 0.5, "p") for i, t in enumerate(texts)] + [(None, "same", 0.5, "p")]
    found = scored(spark.createDataFrame(rows, "doc_id long, text string, score double, `a b` string"), Model(good, bad, weights)).collect()

    def by_hand(text: str | None) -> float:
        raw = (text or "").encode()
        a, b = (len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False).compress(raw)) for d in (good, bad))
        x = weights[0] * (b - a) / (b + a) + weights[1] * math.log1p(len(raw)) + weights[2] * (a + b) / (len(raw) + 10) + weights[3]
        return 1 / (1 + math.exp(-x))

    assert len(found) == len(rows)
    assert collections.Counter((r.doc_id, round(r.score, 12)) for r in found) == collections.Counter((r[0], round(by_hand(r[1]), 12)) for r in rows)
    assert found[0].score > found[1].score
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.5 * x[:, 1] + 0.3)))).astype(float)
    assert np.allclose(logistic(x, y, np.ones(4000)), [1.5, -0.5, 0.3], atol=0.2)


def test_compression_quality(spark):
    from vellum.llm.compression_quality import quality_scores

    docs, labels = labelled(spark, ["awful"])
    found = quality_scores(docs, labels)
    assert found.count() == docs.count() and judged(found, labels, "quality") > 0.95
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found.collect())
    assert {r.predicted for r in quality_scores(docs, labels.where("quality = 1")).collect()} == {1}
    assert quality_scores(docs.limit(0), labels.limit(0)).count() == 0


def test_neighbours(spark):
    from vellum.llm.ann import nearest_of_every_50th

    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:600] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(950, None), (1000, [0.0] * 16), (1050, [1.0] * 15 + [float("nan")]), (1100, [1.0] * 3), (None, [1.0] * 16), (1150, [None] + [1.0] * 15), (1200, [1.0] * 15 + [float("inf")])]
    found = nearest_of_every_50th(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    y = x.astype(float)
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    right = 0
    for q in range(0, 900, 50):
        s = np.round(y @ y[q], 12)
        s[q] = -9
        best = np.lexsort((np.arange(900), -s))[:5].tolist()
        mine = [r for r in sorted(found, key=lambda r: r.rank) if r.query_id == q]
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
        right += len(set(best) & {r.vec_id for r in mine})
        if 300 <= q < 600:
            assert [r.vec_id for r in mine] == best
    assert right >= 0.9 * 18 * 5 and len(found) == 18 * 5
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id) for r in nearest_of_every_50th(few).collect()) == [(0, 7), (0, 50), (50, 0), (50, 7)]
    assert nearest_of_every_50th(few.limit(0)).count() == 0


def test_neighbours_among_many_close_ones(spark, monkeypatch):
    """With codes as coarse for 1,500 close vectors as 256 words are for a hot cluster of a large table."""
    from vellum.llm import ann

    monkeypatch.setattr(ann, "WORDS", 4)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    x[:1500] = x[0] + 1e-4 * rng.normal(size=(1500, 16))
    found = ann.nearest_of_every_50th(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    y, right = x / np.sqrt((x * x).sum(1, keepdims=True)), 0
    for q in range(0, 1500, 50):
        s = ((y - y[q]) ** 2).sum(1)
        s[q] = 9
        right += len(set(np.argsort(s)[:5].tolist()) & {r.vec_id for r in found if r.query_id == q})
    assert right == 30 * 5, right


def test_neighbours_of_repeated_ids(spark):
    from vellum.llm.ann import nearest_of_every_50th

    def found(rows):
        got = nearest_of_every_50th(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        assert sorted((r.query_id, r.rank) for r in got) == [(0, k + 1) for k in range(len(got))]
        return [r.vec_id for r in sorted(got, key=lambda r: r.rank)]

    near = lambda i: (i, [1.0, 0.1 * i])
    own = (0, [1.0, 0.0])
    assert found([own, own, *map(near, range(1, 8))]) == [1, 2, 3, 4, 5]
    assert found([own] * 9 + [(i, own[1]) for i in range(1, 4)] + [near(8), near(8), near(9)]) == [1, 2, 3, 8, 8]
    assert found([(0, [1.0, -0.001 * i]) for i in range(12)] + [*map(near, range(1, 8))]) == [1, 2, 3, 4, 5]


def test_components(spark):
    from vellum.llm.common import Scratch
    from vellum.llm.components import components

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(5, 5)]
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    assert {r.node: r.component for r in found.collect()} == {v: find(v) for v in parent}
