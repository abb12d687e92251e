"""Operators whose results are exact, against DuckDB SQL or brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, line_dedup, queries, sharding, simhash, suffix_dedup, topk, url_filter
from tests.conftest import DATA, TABLES

SF = f"{DATA}/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = ["", None, " \t\n", "one", "one two three", "x" * 5000, "a b c d e f g h\n" * 400, "a b c d e f g h", "\x85nbsp here \x1c sep é", "a b c d e f g h"]


def documents(spark, texts):
    rows = [(i if i % 5 != 4 else None, t, None if i % 2 else "en", None if i % 3 else "web", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumn("component", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("document_", F.lit(2))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, compare, name):
    compare(queries.QUERIES[name](spark, SF), queries.ORACLE[name], SF)


def texts_of(spark, sf=SF):
    return [(r["doc_id"], r["text"]) for r in queries.table(spark, sf, "documents").collect()]


def similar_lines(rows):
    """Brute force: (doc_id, line) removed, over word sets."""
    seen, gone = [], set()
    for doc_id, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for i, line in enumerate(text.split("\n")):
            words = set(line.lower().replace("\t", " ").replace("\r", " ").replace("\f", " ").replace("\v", " ").split(" ")) - {""}
            if words:
                if any(4 * len(words | w) <= 5 * len(words & w) for w in seen):
                    gone.add((doc_id, i))
                seen.append(words)
    return gone


def test_line_dedup_against_brute_force(spark):
    rows = texts_of(spark)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    lines = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 14))] for _ in range(40)]
    for i in range(60):
        line = list(rng.choice(lines))
        for _ in range(rng.randint(0, 2)):
            line[rng.randrange(len(line))] = rng.choice(vocabulary)
        rng.shuffle(line)
        rows.append((100_000 + i, "\n".join([" ".join(line), " ".join(rng.choice(lines)), "", "solo line %d" % i])))
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = {(r["doc_id"], i) for r in found for i in r["removed"]}
    assert gone == similar_lines(rows) and len(found) == len(rows)
    by_id = dict(rows)
    for r in found:
        kept = [x for i, x in enumerate((by_id[r["doc_id"]] or "").split("\n")) if i not in set(r["removed"])]
        assert (r["text"] or "") == "\n".join(kept)


def test_line_dedup_keeps_rows_with_equal_or_no_ids_apart(spark):
    rows = [(2, "the quick brown fox jumps over\nsome other line of text"), (2, "The quick brown fox jumps over\na wholly unique sentence stays here"), (1, "the quick  brown fox jumps\tover"), (None, "only once here\nsome other line of text"), (None, "a line of its own\nonly once here"), (None, None), (3, " \n\n")]
    clash = F.lit(7)
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").coalesce(1)
    docs = docs.withColumns({c: clash for c in ("key", "row", "number", "removed", "lines", "place", "stay", "document_")})
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert {r["n"]: r["text"] for r in kept.collect()} == {0: "some other line of text", 1: "a wholly unique sentence stays here", 2: rows[2][1], 3: "only once here", 4: "a line of its own", 5: None, 6: " \n\n"}


def test_line_dedup_of_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(40)]
    rows = []
    for i in range(1500):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(40)] = word()
        rows.append((i, " ".join(words)))
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], i) for r in found.collect() for i in r["removed"]} == similar_lines(rows)


def test_line_dedup_compares_a_line_once_where_its_likeliest_is_similar(spark, monkeypatch):
    # Four words of each line are its own and the rarest, so no pivot group holds two lines, but all share a prefix word.
    base = [f"common{i}" for i in range(36)]
    rows = [(i, " ".join([*base, *(f"own{i}x{j}" for j in range(4))])) for i in range(120)]
    compared, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, rows: compared.append(pairs.count()) or verified(pairs, rows))
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], i) for r in found for i in r["removed"]} == similar_lines(rows) == {(i, 0) for i in range(1, 120)}
    assert sum(compared) <= 2 * len(rows)


def test_line_dedup_of_similar_lines_of_different_sizes(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        line = rng.sample(words, rng.randint(4, 70))
        rows += [(1000 * rng.randint(0, 9) + 2 * i, " ".join(line)), (1000 * rng.randint(0, 9) + 2 * i + 1, " ".join(rng.sample(line, len(line) * 4 // 5)) + " \t\x0b" * (i % 3))]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], i) for r in found.collect() for i in r["removed"]} == similar_lines(rows)


def reference_fingerprint(text):
    words = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(fps):
    """Brute force: smallest id reachable over links of at most 4 differing bits."""
    ids = sorted(fps)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    rows = texts_of(spark) + [(10_000 + i, t) for i, t in enumerate(AWKWARD)]
    want = {i: reference_fingerprint(t) for i, t in rows}
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in found} == want
    assert {r["doc_id"]: r["component_id"] for r in found} == components(want)


def test_simhash_chains_and_dense_groups(spark):
    rng = random.Random(3)
    center, fps = rng.getrandbits(64), set()
    for _ in range(150):
        f = center
        for _ in range(rng.randint(0, 4)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    chain = rng.getrandbits(64)
    for i in range(0, 60, 4):
        fps.add(chain)
        chain ^= 0xF << i
    fps |= {rng.getrandbits(64) for _ in range(50)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    found = {r["fp"]: r["component"] for r in simhash.link_components(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    want, groups = components({f: f for f in fps}), defaultdict(set)
    for f in fps:
        groups[found[signed(f)]].add(want[f])
    assert len(found) == len(fps) and all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_simhash_meets_all_keys_once_and_moves_no_texts_for_few_copies(spark, monkeypatch):
    met, bucketed = [], simhash._bucketed
    monkeypatch.setattr(simhash, "_bucketed", lambda fps, masks: met.append(1) or bucketed(fps, masks))
    texts = [" ".join(hashlib.md5(f"{i} {j}".encode()).hexdigest() for j in range(9)) for i in range(4000)]
    # One text has a copy, so a single row goes; those that stay are too many for a broadcast.
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[5]])], "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        kept = simhash.one_of_each(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(4000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(met) <= 2 and "hashpartitioning" not in plan, plan


def test_one_of_each_keeps_a_row_of_every_group(spark):
    rng = random.Random(6)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(5))
    # Unrelated texts without ids, one that has a copy with an id, and two texts under one id.
    rows = [(None, a, 1), (None, b, 2), (None, b, 3), (None, c, 4), (7, c, 5), (9, c, 6), (3, d, 7), (3, e, 8), (3, e, 9), (5, e, 10)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, key long").coalesce(1))
    assert kept.columns == ["doc_id", "text", "key"]
    assert sorted(r["key"] for r in kept.collect()) == [1, 2, 5, 7, 8]


def test_decontamination_finds_short_items_in_long_documents(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 8, 20, 60, 200])] + [(6, ""), (7, None), (None, "only null id here now")]
    docs = []
    for i, (_, text) in enumerate(items[:6]):
        words = text.split()
        docs.append((i, " ".join([word() for _ in range(3000)] + [w.upper() for w in words] + [word() for _ in range(777)])))
        cut = " ".join(words[: max(1, int(len(words) * 0.95))])
        docs.append((100 + i, " ".join([word() for _ in range(500)]) + " " + cut))
    docs += [(200, None), (201, ""), (202, items[0][1])]
    contained = set()
    for d, text in docs:
        held = decontaminate.shingles_of(decontaminate.words_of(text))
        for i, t in items:
            own = decontaminate.shingles_of(decontaminate.words_of(t))
            if own and len(own & held) >= 0.8 * len(own):
                contained.add((d, i))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contained_items(frame, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == contained and len(contained) >= 6
    kept = {r["doc_id"] for r in decontaminate.clean(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in contained}


def test_decontamination_misses_no_short_or_scattered_item(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items, docs, want = [], [], set()
    for i in range(60):
        words = [word() for _ in range(5 + i % 10)]
        items.append((i, " ".join(words)))
        docs.append((i, " ".join([word() for _ in range(rng.randint(0, 900))] + words + [word() for _ in range(400)])))
        want.add((i, i))
    # Each five words of an item alone, far from the others.
    words = [word() for _ in range(44)]
    items.append((60, " ".join(words)))
    docs.append((60, " ".join(" ".join(words[k : k + 5] + [word() for _ in range(600)]) for k in range(32))))
    docs.append((61, " ".join(" ".join(words[k : k + 5] + [word() for _ in range(600)]) for k in range(31))))
    want.add((60, 60))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(frame, bench).collect()} == want
    assert [r["doc_id"] for r in decontaminate.clean(frame, bench).collect()] == [61]


def test_bpe_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(queries.word_tokenizer()))
    model.no_truncation()
    model.no_padding()
    special = [t.content for t in model.get_added_tokens_decoder().values()][:5]
    odd = AWKWARD + ["".join(f"a{s}b {s} {s}{s} x{s}" for s in special), "Ünï ＡＢ ﬁ 中文字 안녕 ​  á", "3.14e-10 don't I'm $5 ##x [UNK]", "﻿bom \x00 nul"]
    rows = texts_of(spark) + [(50_000 + i, t) for i, t in enumerate(odd)]
    found = {r["doc_id"]: r for r in queries.bpe_digests(spark.createDataFrame(rows, "doc_id long, text string"), queries.word_tokenizer()).collect()}
    assert len(found) == len(rows)
    for doc_id, text in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        got = found[doc_id]
        assert (got["n_tokens"], got["ids_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest()), text[:80]
        assert got["decoded_sha256"] == hashlib.sha256(model.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_url_filter_rules_and_aliases(spark):
    pages = [
        (1, "http://a.example.com/en/5", ""),
        (2, "HTTP://A.Example.COM/en/77?q#f", None),
        (3, "http://x.org/fr/1", '<link rel="canonical" href="http://y.org/es/2">'),
        (4, "http://z.net/fr/1", '<meta http-equiv="refresh" content="0; url=http://x.org/fr/1">'),
        (5, "http://w.org/fr/9", '<link rel="canonical" href="/es/1">'),
        (6, "http://q.net/fr/2", '<link rel="canonical" href="http://p.net/de/2"><link rel="canonical" href="http://y.org/es/2">'),
        (7, None, None),
        (8, "no scheme", None),
        (9, "http://example.net/de/8", None),
        (10, "http://fr.example.net/de/7", None),
        (10, "http://fr.example.net/de/7", None),
    ]
    found = [tuple(r) for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert Counter(found) == Counter(
        [
            (1, "a.example.com", "/en/5", "com/en/", "block"),
            (2, "a.example.com", "/en/77", "example.com/en/7", "allow"),
            (3, "x.org", "/fr/1", None, "allow"),
            (4, "z.net", "/fr/1", None, "allow"),
            (5, "w.org", "/fr/9", None, "block"),
            (6, "q.net", "/fr/2", None, "allow"),
            (7, "", "", None, "allow"),
            (8, "", "", None, "allow"),
            (9, "example.net", "/de/8", "example.net/de/8", "block"),
            (10, "fr.example.net", "/de/7", "net/de/", "allow"),
            (10, "fr.example.net", "/de/7", "net/de/", "allow"),
        ]
    )
    redirects = spark.createDataFrame([("http://w.org/fr/9", "http://p.net/de/2"), (None, "http://p.net/de/2")], "url string, to string")
    judged = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.URL_RULES, redirects)
    assert {r["verdict"] for r in judged.where("page_id = 5").collect()} == {"allow"}


LINKS = [
    # page's url, link, what it leads to
    ("http://e.io/dir/a", "b", "http://e.io/dir/b"),
    ("http://e.io/dir/a?x=1#f", "../b/./c?y=2#g", "http://e.io/b/c?y=2"),
    ("http://e.io/dir/a/", "..", "http://e.io/dir/"),
    ("http://e.io/dir/a", "../../../b", "http://e.io/b"),
    ("http://e.io/dir/a", "./", "http://e.io/dir/"),
    ("http://e.io", "b", "http://e.io/b"),
    ("http://e.io/p?id=1", "?id=2&amp;z=3", "http://e.io/p?id=2&z=3"),
    ("http://e.io/dir/a", "/x/../y", "http://e.io/y"),
    ("http://e.io/dir/a", "//F.io", "http://F.io/"),
    ("http://e.io/dir/a", "https://f.io?u=http://g.io/", "https://f.io/?u=http://g.io/"),
    ("http://e.io/dir/a", "b?u=http://g.io/", "http://e.io/dir/b?u=http://g.io/"),
    ("http://e.io/dir/a", "#top", None),
    ("http://e.io/dir/a", "", None),
    ("http://e.io/dir/a", "mailto:a@b.io", None),
    ("no scheme", "b", None),
    ("http://e.io/a//b", "c", "http://e.io/a//c"),
]


def test_links_are_resolved_against_their_page(spark):
    rows = spark.createDataFrame([(u, t) for u, t, _ in LINKS], "url string, link string")
    found = rows.select(url_filter.resolved(F.col("url"), F.col("link")).alias("to")).collect()
    assert [r["to"] for r in found] == [to for _, _, to in LINKS]


def test_links_carry_decisions_to_their_own_urls_only(spark):
    pages = [
        (1, "http://e.io/dir/a", '<link rel="canonical" href="b">'),
        (2, "http://e.io/dir/b", '<meta http-equiv="refresh" content="0; url=http://x.org/es/1">'),
        (3, "http://b.io/p?id=1", '<link rel="canonical" href="http://x.org/es/2">'),
        (4, "http://b.io/p?id=2", None),
        (5, "https://B.io/p?id=1#top", None),
    ]
    found = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.URL_RULES)
    assert {r["page_id"]: r["verdict"] for r in found.collect()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block"}


def test_generated_links_give_the_rows_of_recursive_sql(spark, compare, tmp_path):
    rng = random.Random(77)
    hosts = ["a.com", "x.net", "fr.y.org", "Example.com", "z.io", "example.net"]
    paths = ["", "/", "/en/1", "/en/7", "/de/8", "/es/1", "/es/2/x", "/fr/1", "/fr/2?id=1", "/fr/2?id=2#f", "/d/e/f"]
    links = ["b", "../en/1", "?id=2", "/es/1", "//x.net/de/1", "#top", "mailto:x@y", "./../fr/2?id=1&amp;z=2", "http://a.com/en/1", "http://example.net/de/8", "HTTP://Z.io/fr/1"]
    rows = []
    for i in range(160):
        link = rng.choice([*links, rng.choice(["http://", "https://"]) + rng.choice(hosts) + rng.choice(paths)])
        tag = rng.choice([f'<link rel="canonical" href="{link}">', f"<meta http-equiv=refresh content='0; url={link}'>", "<p>none</p>", None, f'<a href="{link}">'])
        rows.append((i, rng.choice(["http://", "https://"]) + rng.choice(hosts) + rng.choice(paths) if i % 20 else rng.choice([None, "no scheme"]), tag))
    for name in TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    (tmp_path / "pages.parquet").unlink()
    spark.createDataFrame(rows, "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    found = queries.op7_url_filter(spark, str(tmp_path))
    assert found.where("rule is null and verdict = 'block'").count() > 3
    compare(found, queries.ORACLE["op7_url_filter"], str(tmp_path))


def test_sharding_counts_slots_and_digests(spark, tmp_path):
    docs = queries.table(spark, SF, "documents").unionByName(documents(spark, AWKWARD).select("doc_id", "text", "lang", "source", "n_chars"))
    n, rows = docs.count(), sharding.shard(docs, 24).collect()
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    assert len(rows) == n and set(by_shard) == set(range(24))
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    import zlib

    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    order = [r["cell"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    sharding.write_shards(docs, str(tmp_path / "shards"), 24)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == n


def test_shards_are_pruned_in_every_dimension(spark):
    docs = queries.table(spark, f"{DATA}/sf0.01", "documents")
    rows = docs.join(sharding.shard(docs, 24).select("doc_id", "shard", "size"), "doc_id").select("shard", "source", "lang", "size", "doc_id").collect()
    # Shares of the 24 shards that a lookup of each value reads; en alone has 62 % of the rows.
    for column, most in (("source", 0.55), ("lang", 0.8), ("size", 0.55), ("doc_id", 0.6)):
        at = ["shard", "source", "lang", "size", "doc_id"].index(column)
        ends = {}
        for r in rows:
            low, high = ends.get(r["shard"], (r[at], r[at]))
            ends[r["shard"]] = (min(low, r[at]), max(high, r[at]))
        values = {r[at] for r in rows}
        read = sum(low <= v <= high for v in values for low, high in ends.values()) / (len(values) * len(ends))
        assert read < most, (column, read)


def test_written_shards_keep_clashing_columns(spark, tmp_path):
    docs = documents(spark, AWKWARD).withColumns({c: F.lit("own") for c in ("key", "row", "slot", "copy", "rank", "text_crc32")})
    sharding.write_shards(docs, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert set(back.columns) == {*docs.columns, "shard"} and back.where("key = 'own' and slot = 'own'").count() == len(AWKWARD)


def test_hilbert_neighbours_are_adjacent():
    import numpy as np

    grid = np.stack(np.meshgrid(*[np.arange(4)] * 4, indexing="ij")).reshape(4, -1)
    index = sharding.hilbert_index(list(grid), 2)
    assert sorted(index) == list(range(256))
    path = grid[:, np.argsort(index)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def test_topk_ties_negatives_and_bad_vectors(spark):
    import math

    rng = random.Random(4)
    vectors = [(i, [rng.choice([-0.5, 0.25, 0.1, -0.003]) for _ in range(6)]) for i in range(120)]
    vectors += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (250, [0.0] * 6), (300, [-9.0, 1e6]), (350, [2.0] * 9), (7, vectors[7][1])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()}
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for i, v in good:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(v) == len(w))
            want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(scored[:5])}
    assert got == want


def test_topk_sums_few_scores(spark, monkeypatch):
    """Rounds and blocks of any size give the same rows; short rows aren't computed, and few pairs are summed."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(600, 16)) * rng.choice([0.05, 0.3, 2.0], size=(600, 1), p=[0.5, 0.4, 0.1])
    rows[::7] = rows[0]
    whole = np.floor(256 * rows).astype(np.int64)
    queries = np.arange(0, 600, 50)
    scores = whole[queries] @ whole.T
    own = queries[:, None] == np.arange(600)[None, :]
    order = [sorted((-s, j) for j, s in enumerate(line) if j != i)[:5] for i, line in zip(queries, scores)]
    want = {(int(i), n + 1, j, -s) for i, line in zip(queries, order) for n, (s, j) in enumerate(line)}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    for block, numbers, size in ((2048, 1 << 21, 1 << 24), (7, 64, 600)):
        for name, value in (("BLOCK", block), ("BLOCK_NUMBERS", numbers), ("ROUND_BYTES", size)):
            monkeypatch.setattr(topk, name, value)
        got = topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()
        assert {tuple(map(int, r)) for r in got} == want and len(got) == len(want)
    heads = topk.heads(whole[queries], whole, own, 5)
    assert (heads <= [[-s for s, _ in line] for line in order]).all()
    at, to, total = topk.entries(whole[queries], whole, heads[:, 4], own)
    assert (total == scores[at, to]).all() and len(at) < 0.5 * own.size
    assert {(int(queries[a]), int(b)) for a, b in zip(at, to)} >= {(i, j) for i, _, j, _ in want}


def without_repeats(rows, window=400):
    """Brute force: (n_bytes, n_removed, n_spans, kept) by row."""
    bodies = [(t or "").encode() for _, t in rows]
    counts = Counter(b[i : i + window] for b in bodies for i in range(len(b) - window + 1))
    out = []
    for (doc_id, _), b in zip(rows, bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if counts[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_suffix_dedup_against_brute_force(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared = [text(n) for n in (399, 400, 401, 900, 2500)]
    rows = [(i, text(rng.randint(0, 600)) + rng.choice(shared) + text(rng.randint(0, 600))) for i in range(30)]
    rows += [(30, "ab" * 900), (31, "x" * 399), (32, "x" * 400), (33, "x" * 401), (34, None), (35, ""), (None, shared[3]), (36, shared[3][100:700] + shared[4][:450]), (36, text(50))]
    rows += texts_of(spark)[:60]
    for batches in (1, 3):
        done = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batches)
        found = done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")).collect()
        assert Counter(map(tuple, found)) == Counter(without_repeats(rows))


def test_an_index_takes_later_batches_in(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared = [text(n) for n in (450, 700, 2000)]
    rows = [(i, text(rng.randint(0, 300)) + rng.choice(shared)[rng.randint(0, 99) :] + text(200)) for i in range(35)] + [(99, None), (98, "")]
    folder, schema = str(tmp_path / "index"), "doc_id long, text string"
    sizes = []
    for at in range(0, len(rows), 8):
        # Each call opens the folder anew.
        index = suffix_dedup.SuffixIndex(spark, folder)
        index.add(spark.createDataFrame(rows[at : at + 8], schema))
        sizes.append([rank for rank, _ in index.levels])
    assert sizes == [[0], [1], [1, 0], [2], [2, 0]]
    for _, level in suffix_dedup.SuffixIndex(spark, folder).levels:
        keys = [r["key"] for r in spark.read.parquet(level).select("key", F.input_file_name().alias("f")).orderBy("f").collect()]
        assert len(keys) == spark.read.parquet(level).count()
    done = suffix_dedup.without_repeats(suffix_dedup.SuffixIndex(spark, folder))
    found = done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")).collect()
    assert Counter(map(tuple, found)) == Counter(without_repeats(rows))


def test_a_failed_batch_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    rng = random.Random(15)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared = text(700)
    rows = [(i, text(100) + shared[rng.randint(0, 99) :]) for i in range(6)]
    schema, folder = "doc_id long, text string", str(tmp_path / "index")
    suffix_dedup.SuffixIndex(spark, folder).add(spark.createDataFrame(rows[:3], schema))
    kept = lambda n: Counter(map(tuple, suffix_dedup.without_repeats(suffix_dedup.SuffixIndex(spark, folder)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())) == Counter(without_repeats(rows[:n]))
    writes = []

    def failing(real, at):
        def write(self, path, *args, **kwargs):
            writes.append(path)
            if len(writes) == at:
                raise OSError(path)
            return real(self, path, *args, **kwargs)

        return write

    # The second batch writes its sample, its array, two lists of matches, the merged array and the state.
    for at in range(1, 7):
        writes.clear()
        with monkeypatch.context() as broken:
            for name in ("parquet", "json"):
                broken.setattr(DataFrameWriter, name, failing(getattr(DataFrameWriter, name), at))
            with pytest.raises(OSError):
                suffix_dedup.SuffixIndex(spark, folder).add(spark.createDataFrame(rows[3:], schema))
        if at > 4:
            assert kept(3)
    assert "states" in writes[-1]
    index = suffix_dedup.SuffixIndex(spark, folder)
    index.add(spark.createDataFrame(rows[3:], schema))
    assert [rank for rank, _ in index.levels] == [1] and kept(6)


def test_neighbours_in_key_order_over_batches():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(13)
    for _ in range(200):
        rows = sorted((rng.randrange(12), rng.choice([1, 1, 1, 2])) for _ in range(rng.randint(0, 25)))
        batches, at = [], 0
        while at < len(rows):
            n = rng.randint(1, 6)
            batches.append(pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[at : at + n]], pa.int64()), pa.array([c for _, c in rows[at : at + n]], pa.int64())], names=["key", "n"]))
            at += n
        found = [k for b in suffix_dedup._neighbours(iter(batches)) for k in b.column(0).to_pylist()]
        total = Counter()
        for k, c in rows:
            total[k] += c
        assert set(found) == {k for k, c in total.items() if c > 1}, (rows, found)


@pytest.mark.parametrize("texts", [[], AWKWARD, [None, None, ""]])
def test_awkward_rows_pass_through_every_operator(spark, texts):
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    n = len(texts)
    assert line_dedup.dedup_lines(docs).count() == n
    assert simhash.near_duplicates(docs).count() == n
    assert sharding.shard(docs).count() == n
    assert suffix_dedup.remove_repeats(docs).count() == n
    assert queries.bpe_digests(docs, queries.word_tokenizer()).count() == n
    assert decontaminate.clean(docs, bench).count() == n - sum("a b c d e f g h" in (t or "") for t in texts)
    assert decontaminate.clean(docs, bench.limit(0)).count() == n
    assert url_filter.judge(docs.select("doc_id", F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html")), queries.URL_RULES).count() == n
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_anchors_of_a_passage_in_most_documents(spark):
    counts = {(0, 0): 900, (0, 1): 2, (1, 0): 30, (2, 5): 3, (3, 3): 1}
    rows = [(i, p, 1, k, c) for p, ((k, c), n) in enumerate(counts.items()) for i in range(n)]
    anchors = spark.createDataFrame(rows, "chunk long, place long, windows int, key long, cover long")
    for drop in ((), ((0, 0),), tuple(counts)):
        twice = [(k, c, n) for (k, c), n in counts.items() if n > 1 and (k, c) not in drop]
        found = suffix_dedup._sure(anchors, spark.createDataFrame(twice, "key long, cover long, n long")).collect()
        assert sorted(map(tuple, found)) == sorted(r[:3] for r in rows if (*r[3:], counts[r[3:]]) in twice)
