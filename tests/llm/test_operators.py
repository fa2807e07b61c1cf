"""The operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import itertools
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from diarist.scratch import scratch_path
from llm import (
    cross_parse, lattice, near_dedup, poisson_mix, quality_mil, queries, rule_list, simhash_bk, slots, suffix_dedup, warc, winnow,
)
from llm import text as T
from llm.components import components
from llm.difference_cover import repeated_windows, suffix_array

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.QUERIES["op1_attention_mil"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in got)
    assert len(got) > 40 and right / len(got) > 0.95


def test_attention_gradient_learns_one_bad_passage():
    rng = np.random.default_rng(1)
    x, bags = rng.normal(0, 1, (600, quality_mil.WIDTH)).astype(np.float32), np.repeat(np.arange(100), 6)
    good = np.arange(100) % 2 == 0
    x[::6, 0] += np.where(good, 0, 8)  # one passage of each bad bag stands out
    model = quality_mil.fit(x, bags, good)
    assert ((model.scores(x, bags, 100) >= 0.5) == good).mean() > 0.95


def test_winnowing_blocks_and_short_items(spark):
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(30)]
    rows = []
    for i in range(60):
        parts = [rng.choices(vocabulary, k=rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            words = rng.choice(items)[1].split()
            a = rng.randrange(len(words))
            parts += [words[a : a + rng.randrange(1, 14)], rng.choices(vocabulary, k=3)]
        rows.append((i, " ".join(itertools.chain(*parts))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, text in rows:
        words, hit, found = text.split(), set(), set()
        for item, own in items:
            own = own.split()
            n = min(10, len(own))
            windows = {tuple(own[j : j + n]) for j in range(len(own) - n + 1)}
            for j in range(len(words) - n + 1):
                if tuple(words[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
        want[i] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    for block in (2_000_000, 60):
        got = winnow.report(winnow.matches(docs, bench, block_words=block)).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got} == want


def test_lattice_sums_all_segmentations():
    names = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"bc", b"abc", b" ab", b"cab"]
    data = np.frombuffer(b"".join(names), np.uint8)
    ends = np.cumsum([len(n) for n in names])
    hashes = T.span_hash(T.prefix_hash(data), ends - [len(n) for n in names], ends)
    weights = np.random.default_rng(2).random(len(names))
    weights /= weights.sum()
    order = np.argsort(hashes)
    pieces = lattice.Pieces(hashes[order], np.log(weights)[order], 3)
    by_name = dict(zip(names, weights))

    def cuts(word):
        if not word:
            yield []
        for n in (1, 2, 3):
            if len(word) >= n and word[:n] in by_name:
                yield from ([word[:n], *rest] for rest in cuts(word[n:]))

    words = ["abcab", "a", "cabbage", "x", "ab"]
    total, counts = [], collections.Counter()
    for word in words:
        ways = [(c, math.prod(by_name[p] for p in c)) for c in cuts(b" " + word.encode())]
        total.append(math.log(sum(p for _, p in ways)))
        for c, p in ways:
            for piece in c:
                counts[piece] += p / math.exp(total[-1])
    assert np.allclose(lattice.log_marginals(pa.array(words), pieces), total)
    expected = lattice.expected_counts(pa.array(words), pieces)
    assert np.allclose(expected, [counts[names[i]] for i in order])


def test_lattice_counts_and_base(spark, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op3_subword_lattice"](spark, SF).collect()}
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in texts.items()}
    taught = collections.Counter()
    for i, own in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            taught.update(own)
    n, v = sum(taught.values()), len(taught)
    for i, own in tokens.items():
        base = sum(math.log10((taught[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(taught[w] > 0 for w in own), n)
        assert abs(r.base_score - base) < 1e-6 and r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert -1e9 < r.score < 0


def test_slots_are_even_and_gapless(spark, texts):
    rows = queries.QUERIES["op4_virtual_slots"](spark, SF).collect()
    load, place = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        load[r.shard] += r.size
        place[r.shard].append(r.slot)
    assert sorted(load) == list(range(8)) and max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 8
    assert all(sorted(p) == list(range(len(p))) for p in place.values())


def test_slot_map_grows_by_few_moves(spark):
    sizes = spark.range(256).selectExpr("cast(id as int) virtual_slot", "100 + id slot_bytes", "1L slot_rows")
    path = scratch_path(spark, "map")
    slots.save_map(slots.first_map(spark, 4, 256), path)
    slots.save_map(slots.rebalance(slots.load_map(spark, path, 0), sizes, 4), path)
    slots.save_map(slots.rebalance(slots.load_map(spark, path, 1), sizes, 5), path)
    old, new = ({r.virtual_slot: r.shard for r in slots.load_map(spark, path, v).collect()} for v in (1, 2))
    load = collections.Counter()
    for slot, shard in new.items():
        load[shard] += 100 + slot
    assert len(new) == 256 and max(load.values()) - min(load.values()) < 300
    moved = [s for s in new if new[s] != old[s]]
    assert 40 < len(moved) < 110 and sum(new[s] == 4 for s in moved) > 0.8 * len(moved)


def test_automaton_knows_all_substrings():
    text = b"abracadabra banana"
    steps = cross_parse.suffix_automaton(text)

    def known(s):
        at = 0
        for c in s:
            if c not in steps[at]:
                return False
            at = steps[at][c]
        return True

    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(known(s) for s in subs)
    assert not any(known(bytes(s)) for n in (1, 2, 3) for s in itertools.product(b"abrcdn z", repeat=n) if bytes(s) not in subs)


def test_cross_parsing_counts_phrases():
    samples = {"x": b"the cat sat on the mat ", "y": b"eine katze sitzt auf der matte "}
    learned = cross_parse.Languages(samples)
    rng = random.Random(1)
    texts = ["".join(rng.choices("thecasonmize ", k=rng.randrange(1, 900))) for _ in range(30)]
    got = learned.entropies(pa.array(texts))
    for row, text in zip(got, texts):
        data = cross_parse.letters(pa.array([text]))[0].tobytes()
        for i, name in enumerate(learned.names):
            phrases = 0
            for a in range(0, len(data), cross_parse.CHUNK):
                part, at = data[a : a + cross_parse.CHUNK], 0
                while at < len(part):
                    n = 1
                    while at + n < len(part) and part[at : at + n + 1] in samples[name]:
                        n += 1
                    at, phrases = at + n, phrases + 1
            want = phrases * math.log2(len(samples[name])) / max(len(data), 1)
            assert abs(row[i] - want) < 1e-9


def test_language_held_out_and_blocks(spark, docs):
    got = queries.QUERIES["op5_cross_parse"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    learned = cross_parse.samples(docs)
    one, two = (
        sorted(map(tuple, cross_parse.identify(docs.select("doc_id", "text"), learned, block=b).select("doc_id", "lang_pred", "score").collect()))
        for b in (8, 1)
    )
    assert one == two


def test_poisson_counts(spark, docs, texts):
    weights = spark.createDataFrame([("src0", 3.0), ("src1", 1.0)], "source string, weight double")
    path = scratch_path(spark, "rates")
    mixed = poisson_mix.mix_documents(docs, path, weights, epochs=2.0)
    rates = {r.source: r.rate for r in spark.read.parquet(path).collect()}
    got = collections.Counter(r.doc_id for r in mixed.select("doc_id").collect())
    total = sum(len(t.encode()) for t in texts.values())
    size = collections.Counter()
    for r in docs.select("doc_id", "source").collect():
        size[r.source] += len(texts[r.doc_id].encode())
    assert abs(rates["src0"] - 2 * total * 0.75 / size["src0"]) < 1e-9 and rates["src5"] == 0
    for r in docs.select("doc_id", "source").collect():
        mean = rates[r.source]
        parts = max(1, math.ceil(mean / poisson_mix.PART))
        want = 0
        for i in range(1, parts + 1):
            u = int(hashlib.md5(f"17:{r.doc_id}:{i}".encode()).hexdigest()[:13], 16) / 2**52
            p, below, n = math.exp(-mean / parts), 0.0, 0
            below = p
            while below <= u:
                n += 1
                p *= mean / parts / n
                below += p
            want += n
        assert got[r.doc_id] == want
    assert abs(sum(got[i] for i in got) - sum(rates[r.source] for r in docs.select("source").collect())) < 200


def test_warc_segments_in_any_order_and_missing(spark):
    payload = ("é<p>WARC/1.1\r\n\r\n" * 700).encode()
    made = warc.page_records("7", "http://x\r\ny", payload, warc.digest32(payload), None, 1000, 300)
    assert len(made) > 8
    random.Random(2).shuffle(made)
    content = warc.END.encode().join([*made, b""])
    records = list(warc.parse_archive(content))
    for drop, complete in ((None, True), (2, False), (1, False), (len(made), False)):
        some = [r for r in records if r["segment"] != drop]
        rows = spark.createDataFrame([tuple(r.values()) for r in some], warc.RECORD)
        got = warc.reassemble(rows).collect()
        assert len(got) == 1 and got[0].complete == complete
        if complete:
            assert bytes(got[0].payload) == payload and got[0].uri == "http://x y"


def test_chunked_framing():
    for size in (1, 7, 4096):
        for payload in (b"", b"x", b"0\r\n\r\n" * 50):
            assert warc.unchunked(warc.chunked(payload, size)) == (payload, True)
    assert warc.unchunked(b"5;name=x\r\nhello\r\n0\r\nTrailer: 1\r\n\r\n") == (b"hello", True)
    assert not warc.unchunked(b"9\r\nhello\r\n0\r\n\r\n")[1] and not warc.unchunked(b"zz\r\n")[1]


def test_warc_odd_pages(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (None, "u", "same"), (None, None, None), (4, "u", ""),
            (5, "u", "ß" * 40_000), (3, "u", "same"), (1, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_path(spark, "archives")
    warc.write_archives(pages, path)
    got = sorted((str(r.page_id), r.record_type, r.payload_bytes, str(r.refers_to)) for r in warc.read_pages(spark, path).collect())
    want = [("1", "response", 4, "None"), ("1", "response", 4, "None"), ("2", "revisit", 4, "1"), ("2", "revisit", 4, "1"),
            ("3", "revisit", 4, "1"), ("4", "response", 0, "None"), ("5", "response", 80_000, "None"),
            ("None", "response", 0, "None"), ("None", "response", 4, "None")]
    assert got == want
    empty = scratch_path(spark, "archives")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_pages(spark, empty).count() == 0


def _simhash(text, width=4):
    words = WORD.findall(lower(text))
    grams = [" ".join(words[j : j + width]) for j in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tree_size", [20_000, 3])
def test_simhash_components(spark, tree_size):
    rng = random.Random(9)
    base = [f"v{rng.randrange(3000)}" for _ in range(400)]
    rows = [(100 - i, " ".join(base[:j] + ["X" * i] + base[j:])) for i, j in enumerate(rng.sample(range(400), 25))]
    rows += [(200 + i, " ".join(f"v{rng.randrange(3000)}" for _ in range(30))) for i in range(25)] + [(300, ""), (301, None)]
    got = {r.doc_id: r for r in simhash_bk.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), tree_size=tree_size).collect()}
    bits = {i: _simhash(t) for i, t in rows}
    part = {i: i for i in bits}
    for _ in bits:
        for a, b in itertools.combinations(bits, 2):
            if (bits[a] ^ bits[b]).bit_count() <= 4:
                part[a] = part[b] = min(part[a], part[b])
    assert {i: (r.bits % 2**64, r.component_id) for i, r in got.items()} == {i: (bits[i], part[i]) for i in bits}
    assert len(set(part.values())) < len(part) - 10


def test_bk_tree_finds_all():
    rng = random.Random(4)
    values = [rng.getrandbits(16) for _ in range(300)]
    tree = simhash_bk.BKTree()
    for v in values:
        tree.add(v)
    for q in values[::20]:
        want = sorted(i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3)
        assert sorted(tree.near(q, 3)) == want


def test_components_of_a_path_and_a_star(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[500] == 500


def plain_fingerprint(text):
    words = WORD.findall(lower(text))
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


@pytest.mark.parametrize("tree_size", [20_000, 4])
def test_one_of_each_group_stays(spark, tree_size):
    rng = random.Random(6)
    rows = [(900, None), (901, ""), (902, " \t")]
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        rows.append((g * 10, " ".join(base)))
        for c in range(1, 6):
            base[rng.randrange(len(base))] = "changed"
            rows.append((g * 10 + c, " ".join(base)))
    rows += [(5, "another text under a doc_id that is there already, with words of its own"), rows[3], rows[3]]
    nodes = sorted({(i, t or "") for i, t in rows})
    prints = {n: plain_fingerprint(n[1]) for n in nodes}
    least = {n: n for n in nodes}
    for _ in nodes:
        for a, b in itertools.combinations(nodes, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                least[a] = least[b] = min(least[a], least[b])
    want = sorted(i for (i, _), own in {n: least[n] for n in nodes}.items() if own == (i, _))
    linked = sum(least[n] != n for n in nodes)
    got = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), tree_size=tree_size).collect()
    assert sorted(r.doc_id for r in got) == want and linked > 10


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(400):
        s = rng.integers(1, rng.integers(2, 6), rng.integers(0, 40))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    for width in (3, 8, 13):
        s = rng.integers(0, 3, 500).astype(np.uint8)
        starts = np.arange(500 - width + 1)
        owner = starts // 50
        least = {}
        for i in starts:
            least.setdefault(s[i : i + width].tobytes(), owner[i])
        want = [least[s[i : i + width].tobytes()] < owner[i] for i in starts]
        assert repeated_windows(s, starts, owner, width).tolist() == want


@pytest.mark.parametrize("many", [2000, 1])
def test_repeats_removed(spark, many):
    rng = random.Random(8)
    pool = ["".join(rng.choices("abcdefgh ", k=rng.randrange(30, 200))) for _ in range(12)]
    rows = []
    for i in range(80):
        text = "".join("".join(rng.choices("abc é", k=rng.randrange(80))) + rng.choice(pool) for _ in range(rng.randrange(4)))
        rows.append((rng.randrange(10_000), text))
    rows += [(rows[0][0], rows[0][1]), (3, "ab" * 400), (5, "ab" * 300), (None, "ab" * 200)]
    got = sorted(
        (str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
        for r in suffix_dedup.remove_repeats(
            spark.createDataFrame(rows, "doc_id long, text string").repartition(5), many=many, block_bytes=2000, bucket_bytes=20_000,
            sort_bytes=3000).collect()
    )
    order = lambda i: 10**9 if i is None else i
    least = {}
    for i, t in rows:
        b = t.encode()
        for s in range(len(b) - 49):
            least[b[s : s + 50]] = min(order(i), least.get(b[s : s + 50], 10**9))
    want = []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if least[b[s : s + 50]] < order(i):
                gone[s : s + 50] = b"\1" * 50
        runs = sum(1 for x in bytes(gone).split(b"\0") if x)
        want.append((str(i), len(b), sum(gone), runs, bytes(x for x, y in zip(b, gone) if not y)))
    assert got == sorted(want) and any(w[2] for w in want)


def test_rule_counts(spark, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op10_rule_list"](spark, SF).collect()}
    for i, text in texts.items():
        words = WORD.findall(text)
        grams = collections.Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
        twice, lines, seen = set(), 0, set()
        for j in range(len(words) - 4):
            if grams[tuple(words[j : j + 5])] > 1:
                twice |= set(range(j, j + 5))
        for line in text.split("\n"):
            if WORD.search(line):
                lines += line in seen
                seen.add(line)
        r = got[i]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(twice))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 10 or 100 * len(twice) > 20 * len(words)) and not (r.base_failed and r.kept)


def test_rules_are_ordered_conjunctions(spark):
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(rule_list.FEATURES)))
    bad = (x[:, 1] > 0.8) & (x[:, 2] <= 0.5) | (x[:, 4] > 0.95)
    rules = rule_list.learn(x, bad)
    said = np.zeros(len(x), bool)
    for rule in rules:
        said |= rule_list._covers(x, rule)
    assert (said == bad).mean() > 0.98 and all(len(r) <= 4 for r in rules)
    counts = spark.createDataFrame([(10, 50, 9, 0, 0, 1, 60, 0, 0, 1, 10, 0)], rule_list.COUNTS)
    assert not counts.select(rule_list.verdict([[(1, True, 0.5)]])).first()[0]
    assert counts.select(rule_list.verdict([[(1, True, 0.95)]])).first()[0]


def test_rules_on_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.QUERIES["op10_rule_list"](spark, SF).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) / len(got) > 0.97
