"""Each corpus operator against a plain version, on rows that hold nulls, empty, long, tied and repeated texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import (
    decontamination, html_text, licenses, packing, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, token_counts, tokens, weak_labels,
)
from tidemark.llm.common import Scratch

# Extra columns carry names that operators use inside.
SCHEMA = "doc_id long, text string, source string, n_words long, chunk string, fp string, _text string, rank long, host string"


def corpus() -> list[tuple]:
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgéß") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, texts = say(60), []
    for k in range(30):
        texts.append(say(r.randint(12, 200)) + ("\n" + shared + "\n" if k % 3 == 0 else "") + say(5))
    texts += [texts[0], texts[0], texts[1].replace(" ", "  ", 3), " ".join(texts[2].split()[:-2] + ["changed", "end"])]
    texts += [None, "", "   \n\t ", "one", "Two words", "spam " * 120, "# * $ % & | < > " * 20, say(30) + "\n" + say(4000), "x" * 900, "<|endoftext|> tail <|startoftext|>"]
    rows = [(k, t, "big" if k % 3 == 0 else f"h{k % 5}") for k, t in enumerate(texts)]
    rows += [rows[3], (None, texts[4], None), (None, None, None)]  # a repeated row, null ids
    return [(*x, 1, "c", "f", "t", 2, "h") for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def big(i):
    return float("inf") if i is None else i


def test_window_dedup(docs, none):
    texts = [(i, (t or "").encode().split()) for i, t, *_ in corpus()]
    first: dict[tuple, float] = {}
    for i, w in texts:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, float("inf")), big(i))
    want = Counter()
    for i, w in texts:
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < big(i) for j in range(13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    for chunk in (4 << 20, 3000):
        out = substring_dedup.remove_repeated_windows(docs, chunk_bytes=chunk)
        assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substring_dedup.remove_repeated_windows(none).count() == 0
    carried = substring_dedup.remove_repeated_windows(docs, carry=["source", "chunk"]).where("doc_id = 3").first()
    assert '"chunk":"c"' in carried["carry"]


@pytest.mark.parametrize("length, period, chunk", [(200, 133, 2 << 20), (40, 31, 2000), (20, 13, 500)])
def test_byte_dedup(docs, none, length, period, chunk):
    texts = [(i, (t or "").encode()) for i, t, *_ in corpus()]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    want = Counter()
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[i, len(t), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()] += 1
    out = suffix_dedup.remove_repeated_bytes(docs, length, period, chunk_bytes=chunk)
    got = Counter((r["doc_id"], r["n_bytes"], len(r["spans"]), r["kept_sha256"]) for r in out.collect())
    assert got == want
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0


@pytest.mark.parametrize("period", sorted(suffix_dedup.COVERS))
def test_covers_hold_every_difference(period):
    d = suffix_dedup.COVERS[period]
    assert {(a - b) % period for a in d for b in d} == set(range(period))


def groups_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_fingerprint_and_components(docs, none):
    def plain(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        grams = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(i, plain(t)) for i, t, *_ in corpus()]
    prints = sorted({p for _, p in rows})
    group = groups_of([(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 4], prints)
    low: dict[int, float] = {}
    for i, p in rows:
        low[group[p]] = min(low.get(group[p], float("inf")), big(i))
    want = Counter((i, f"{p:016x}", low[group[p]]) for i, p in rows)
    assert rows_of(simhash_dedup.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("large, covering", [(8192, False), (8192, True), (3, False), (20, True)])
def test_links_keep_components(spark, large, covering):
    r = random.Random(5)
    prints = {0, 1 << 63, (1 << 64) - 1}
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(40):
            prints.add(x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))))
        for _ in range(10):
            x ^= 1 << r.randrange(64)
            prints.add(x)
    signed = {p: p - (1 << 64) if p >= 1 << 63 else p for p in prints}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    found = simhash_dedup.links(df, 4, large, Scratch(spark, "t"), masks=simhash_dedup.covering_masks() if covering else None)
    crowded = found.where("a = b").selectExpr("a as fp")
    assert (crowded.count() > 0) == (large < 8192)
    edges = found.where("a != b").unionByName(simhash_dedup.neighbour_links(crowded, 4)).collect()
    want = groups_of([(signed[a], signed[b]) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 4], signed.values())
    assert groups_of([tuple(e) for e in edges], signed.values()) == want


def test_covering_masks_hold_a_triple_of_every_four_bytes():
    chosen = [{p for p in range(8) if m >> 8 * p & 0xFF} for m in simhash_dedup.covering_masks()]
    assert len(chosen) == 20 and all(any(t <= set(four) for t in chosen) for four in combinations(range(8), 4))


def test_components_of_a_long_chain(spark):
    n = 1000
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(5000, 5001), (5001, 5001)], "a long, b long")
    got = dict(simhash_dedup.components(edges, Scratch(spark, "t")).collect())
    assert got == {k: 0 for k in range(1, n + 1)} | {5001: 5000}


def test_one_row_of_each_similar_group_stays(spark, docs, none):
    rows = [(i, (t or "").encode()) for i, t, *_ in corpus() if i is not None]
    sets = {i: set(simhash_dedup.shingle_set(t, 5).tolist()) for i, t in rows}
    alike = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {i for i, g in groups_of(alike, sets).items() if i == g}
    kept = [r["doc_id"] for r in simhash_dedup.keep_one(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(want) and kept.count(None) == 2
    assert simhash_dedup.keep_one(none).count() == 0


def similar_by_all_pairs(texts):
    """Groups over every pair of texts at a five-word Jaccard similarity of 0.8."""
    sets = [set(simhash_dedup.shingle_set(t.encode(), 5).tolist()) for t in texts]
    alike = [(a, b) for a, b in combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return alike, groups_of(alike, range(len(sets)))


def similar_by_operator(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return dict(simhash_dedup.similar_groups(df, Scratch(spark, "t"), **how).collect())


def test_copies_with_added_cut_and_replaced_blocks_are_found(spark):
    r = random.Random(5)
    say = lambda n: ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]
    texts = []
    for k in range(40):
        base = say(200)
        edits = [base + say(44), say(40) + base, base[:165], base[35:], base[:90] + say(15) + base[105:], base[:60] + say(30) + base[60:]]
        texts += [base, edits[k % 6]]
    alike, want = similar_by_all_pairs([" ".join(t) for t in texts])
    assert len(alike) == 40
    assert similar_by_operator(spark, [" ".join(t) for t in texts]) == want


def test_pairs_inside_a_family_of_pages_are_all_tested(spark):
    r = random.Random(6)
    say = lambda n: ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]
    frame, texts = say(120), []
    for _ in range(40):  # pairs at 0.98 in a family at 0.65
        page = frame + say(30)
        texts += [page, page[:-1] + say(1)]
    r.shuffle(texts)
    alike, want = similar_by_all_pairs([" ".join(t) for t in texts])
    assert len(alike) == 40
    # One hash a band: most of the family shares every posting, and each takes several rounds.
    assert similar_by_operator(spark, [" ".join(t) for t in texts], rows=1) == want


def test_pairs_among_pages_of_the_same_words_are_found(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(150)]
    texts = []
    for _ in range(20):
        page = r.sample(words, len(words))
        texts += [page, page[:70] + page[71:]]
    alike, want = similar_by_all_pairs([" ".join(t) for t in texts])
    assert len(alike) == 20
    assert similar_by_operator(spark, [" ".join(t) for t in texts]) == want


def test_quality_counts_and_verdicts(spark, docs, none):
    def plain(text):
        text = text or ""
        w = [x.decode() for x in text.encode().split()]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)

    out, hosts = quality_rules.host_quality(docs)
    got = rows_of(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == Counter((i, *plain(t)) for i, t, *_ in corpus())
    assert out.where("base_failed and kept").count() == 0 and hosts.where("host is null").count() == 1
    assert quality_rules.host_quality(none)[0].count() == 0 and quality_rules.keep_good(none).count() == 0


def test_bad_hosts_fail_and_small_ones_are_shrunk(spark, monkeypatch):
    good = " ".join(f"w{k}" for k in range(40))
    rows = [(k, good + f" {k}", "good") for k in range(300)] + [(1000 + k, "few", "bad") for k in range(200)] + [(2000, good, "bad")]
    rows += [(3000 + k, "few" if k == 0 else good, f"h{k % 40}") for k in range(400)] + [(4000, "few", "tiny"), (4001, good, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (quality_rules.BROADCAST_HOSTS, 0):  # broadcast, and joined by salt
        monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", limit)
        kept = {r["doc_id"] for r in quality_rules.host_quality(df)[0].where("kept").collect()}
        assert 2000 not in kept and 4001 in kept and 3001 in kept and 5 in kept and 3000 not in kept
        assert {r["doc_id"] for r in quality_rules.keep_good(df).collect()} == kept


@pytest.mark.parametrize("text", ["a \n b", "x \n \n y", "  two", "end ", "tab\t b", "a  b", "İ Σ ΑΣ", "don't 's 12 3.4!!", "\n\n a", "", " ", "é,x?", "ﬁ ½ ²", "é a b　c", "<|endoftext|> z"])
def test_pieces_give_the_library_ids(text):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.byte_level_ids("byte_bpe_50k.json", [text])[0], "<u4").tolist() == whole
    n = len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids)
    assert tokens.count_tokens("word_bpe_49k.json", [text]) == [n]


def test_token_counts_and_their_cache(spark, docs, none, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, x, *_ in corpus():
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want[i, len((x or "").encode()), n, n > 2048] += 1
    cache = str(tmp_path / "cache")
    columns = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert rows_of(token_counts.cached_counts(docs, cache=cache), *columns) == want
    stored = spark.read.parquet(cache).count()

    def never(name, texts):
        raise AssertionError("a stored count was encoded again")

    assert rows_of(token_counts.cached_counts(docs, cache=cache, count=never), *columns) == want
    assert spark.read.parquet(cache).count() == stored
    assert token_counts.cached_counts(none).count() == 0


@pytest.mark.parametrize("capacity, slack", [(1024, 0.01), (64, 0.01), (64, 0.5)])
def test_packing_round_trip(docs, none, capacity, slack):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(docs, capacity=capacity, slack=slack).collect()
    whole = defaultdict(list)
    for i, x, *_ in corpus():
        whole[i].append(np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4"))
    sequences, cuts = defaultdict(list), Counter()
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        fits = [w for w in whole[p["doc_id"]] if len(w) == p["doc_tokens"] and zlib.crc32(w[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]]
        assert fits
        cuts[p["doc_id"]] += p["length"]
    assert cuts == Counter({i: sum(map(len, w)) for i, w in whole.items()})
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack_documents(none).count() == 0


def test_rank_file_gives_the_library_ids():
    """Ids ascend in the order of merges, and encodings of vocabulary entries, alone and in pairs, are equal."""
    library, ranked = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokens.ranked("byte_bpe_50k.json")
    r = random.Random(8)
    entries = [t.decode() for t in (ranked.decode_single_token_bytes(k) for k in range(50_256)) if t.isascii()]
    tried = entries + [r.choice(entries) + r.choice(entries) for _ in range(50_000)] + [" " * 300_000, "a" * 300_000]
    got = tokens.byte_level_ids("byte_bpe_50k.json", tried)
    want = library.encode_batch(tried, add_special_tokens=False)
    assert all(np.frombuffer(a, "<u4").tolist() == b.ids for a, b in zip(got, want))


def test_inverse_and_solver_after_a_spark_action(spark):
    assert spark.range(1000).groupBy().count().first()[0] == 1000
    r = np.random.default_rng(1)
    a = r.standard_normal((60, 60))
    assert np.abs(packing.inverse_of(a) @ a - np.eye(60)).max() < 1e-8
    patterns, x = packing.cutting_stock(np.arange(1, 257), r.integers(1, 5000, 256), 256)
    assert (x >= 0).all() and (patterns @ np.arange(1, 257) <= 256).all()


def test_column_generation_reaches_the_bound():
    r = np.random.default_rng(1)
    lengths = np.arange(1, 129)
    counts = (r.poisson(500, 128) * np.exp(-lengths / 60)).astype(int)
    lengths, counts = lengths[counts > 0], counts[counts > 0]
    patterns, x = packing.cutting_stock(lengths, counts, 128)
    assert np.allclose(patterns.T @ x, counts, atol=1e-3) and (patterns @ lengths <= 128).all()
    assert x.sum() <= 1.01 * (lengths * counts).sum() / 128
    for kind, low, high, per, *_ in packing.slots(lengths, counts, 128, 0.01):
        assert 0 <= low < high <= counts[lengths == kind][0] and (high - low) % per == 0


ARTICLE = "<article><h1>A &amp; B</h1><p>First   long paragraph of the article, with <b>bold</b> words.<p>Short.</p><p>Last long paragraph of the article text.<br>More&nbsp;of it.</p></article>"
TEXT = "A & B First long paragraph of the article, with bold words. Short. Last long paragraph of the article text. More of it."


@pytest.mark.parametrize("page", [
    f"<html><head><title>t</title><script>var a='<p>';</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav>{ARTICLE}<footer>&copy; someone wrote a longer footer</footer>",
    f"<body><header><h2>Site name and a long slogan of the site</h2></header><div class='cookie-notice'>We use cookies, long notice text here</div><main>{ARTICLE}</main><aside>side text side text</aside></body>",
    f"<body><div id=wrap>{ARTICLE}<div class='comments'><p>A reader's comment that is rather long, longer than others.</p></div><form><p>Join the newsletter</p><input></form></div></body>",
    "<body><div class='sidebar'><p>Links</p></div><div id='post'>" + ARTICLE.replace("article>", "section>", 1).replace("</article>", "</section>") + "</div><div class='ad'>Buy this now</div></body>",
])
def test_article_text(page):
    assert html_text.main_text(page) == TEXT


SAYS = lambda n: f"<p>{'word ' * (n // 5)}</p>"


@pytest.mark.parametrize("body", [
    f"<article>{SAYS(300)}<ul>{'<li>' + 'item ' * 68 + '</li>'}{'<li>' + 'item ' * 68 + '</li>'}{'<li>' + 'item ' * 68 + '</li>'}</ul>{SAYS(300)}</article>",
    f"<div>{SAYS(300)}<blockquote>{SAYS(350) * 3}</blockquote>{SAYS(300)}</div>",
    f"<article><h1>Headline</h1><div class=body>{SAYS(300) * 3}</div></article>",
    f"<div><h1>Headline</h1><div class=body>{SAYS(300) * 3}</div></div>",
    f"<div><section>{SAYS(300) * 4}</section><section>{SAYS(300) * 2}</section></div>",
    f"<main><section><h2>One</h2>{SAYS(300) * 4}</section><section><h2>Two</h2>{SAYS(300) * 2}</section></main>",
])
def test_article_with_lists_sections_and_headline_is_whole(body):
    plain = " ".join(re.sub(r"<[^>]*>", " ", body).split())
    assert html_text.main_text(f"<body><nav><a href=x>menu</a></nav>{body}<footer>Imprint</footer></body>") == plain


@pytest.mark.parametrize("opening", [
    "<div class='content-sidebar-wrap'>", "<main class='no-sidebar'>", "<article class='post comments-open'>", "<div id=page class='has-header'>", "<div class='side-by-side'>",
])
def test_wrappers_named_like_other_parts_keep_the_article(opening):
    closing = f"</{opening[1:].split()[0]}>"
    page = f"<body>{opening}<h1>Headline</h1>{SAYS(300) * 3}<section class='related-work'><h2>Other work</h2>{SAYS(200)}</section><div class='comments'>{SAYS(250)}</div>{closing}</body>"
    assert html_text.main_text(page) == " ".join(["Headline"] + ["word"] * 180 + ["Other work"] + ["word"] * 40)


def test_extraction_of_odd_pages(spark):
    rows = [(1, None, None, 1), (2, "u", "", 1), (None, "u", "plain words only", 1), (3, "u", "<p>" + "long " * 50_000, 1), (4, "u", "<nav>only menu", 1), (4, "u", "<nav>only menu", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = rows_of(html_text.extract(df), "page_id", "n_chars")
    assert got == Counter({(1, 0): 1, (2, 0): 1, (None, 16): 1, (3, 249_999): 1, (4, 0): 2})
    assert html_text.extract(df.limit(0)).count() == 0


def test_tiling_finds_moved_parts(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(40)]
    moved = item[25:] + item[10:25] + item[:10]
    noise = lambda n: [word() for _ in range(n)]
    rows = [
        (1, " ".join(noise(300) + item + noise(300))), (2, " ".join(noise(50) + moved + noise(20)).upper()), (3, " ".join(noise(400))), (4, " ".join(item[:12] + noise(100))),
        (5, None), (6, ""), (None, " ".join(item)), (7, " ".join(noise(20_000) + item)), (7, " ".join(noise(20_000) + item)), (8, ", ".join(item)),
    ]
    docs = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(9, " ".join(item)), (10, "two words"), (11, None), (None, " ".join(noise(20)))], "item_id long, text string")
    for block in (8 << 20, 10):  # one block, and one per item
        got = Counter((x["doc_id"], x["item_id"], x["matched_words"], x["n_tiles"]) for x in decontamination.find_leaks(docs, bench, block_bytes=block).collect())
        assert got == Counter({(1, 9, 40, 1): 1, (2, 9, 40, 3): 1, (None, 9, 40, 1): 1, (7, 9, 40, 1): 2, (8, 9, 40, 1): 1})
        assert sorted(x["doc_id"] for x in decontamination.keep_clean(docs, bench, block_bytes=block).collect()) == [3, 4, 5, 6]
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0 and decontamination.find_leaks(docs.limit(0), bench).count() == 0


def test_tiles_against_exhaustive_greedy_search():
    def plain(a, b, least):
        fa, fb, out = [True] * len(a), [True] * len(b), 0
        while True:
            best = (least - 1, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            n, i, j = best
            if n < least:
                return out
            out += n
            fa[i : i + n], fb[j : j + n] = [False] * n, [False] * n

    r = np.random.default_rng(4)
    for _ in range(30):
        a, b = r.integers(1, 6, 30).astype(np.uint64), r.integers(1, 6, 45).astype(np.uint64)
        found = decontamination.tile(a, b, 3)
        assert all((a[p : p + n] == b[q : q + n]).all() and n >= 3 for p, q, n in found)
        assert abs(sum(n for *_, n in found) - plain(a.tolist(), b.tolist(), 3)) <= 4  # ties may be marked in another order


def test_license_scan(spark):
    notice = dict(licenses.NOTICES)
    filler = " ".join(f"word{k}" for k in range(500))
    rows = [
        (1, filler + "\n" + notice["MIT"] + "\n" + filler), (2, notice["Apache-2.0"].upper() + " " + notice["GPL-3.0"]), (3, filler), (4, None), (5, ""),
        (6, filler + " " + notice["MIT-permission"] + " " + filler), (7, "Released under"), (None, notice["CC-BY-NC-4.0"]), (1, filler + "\n" + notice["MIT"] + "\n" + filler),
    ]
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, pos int")
    got = Counter((r["doc_id"], r["license"]) for r in licenses.scan(docs).collect())
    assert got == Counter([(1, "MIT"), (2, "Apache-2.0"), (2, "GPL-3.0"), (6, "MIT-permission"), (None, "CC-BY-NC-4.0")])
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_scan_of_full_texts(spark):
    whole = dict(licenses.full_texts())
    filler = " ".join(f"word{k}" for k in range(333))
    docs = spark.createDataFrame([(k, f"{filler} {t} {filler}") for k, t in enumerate(whole.values())] + [(99, filler)], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(docs, licenses.templates(spark, list(whole.items()))).collect()}
    assert all((k, name) in got and got[k, name]["n_shared"] == got[k, name]["n_shingles"] for k, name in enumerate(whole))
    assert all(k == list(whole).index(name) for k, name in got)


def test_label_model_recovers_accuracies():
    r = np.random.default_rng(0)
    bad = r.random(20_000) < 0.2
    right = np.array([0.9, 0.8, 0.75, 0.7])
    votes = np.where(r.random((20_000, 4)) < right, 1 + bad[:, None], 2 - bad[:, None])
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, table = weak_labels.expectation_maximisation(patterns, counts.astype(float), 0.2)
    assert np.abs(table[1, :, weak_labels.BAD] - right).max() < 0.05
    assert ((posterior[which.ravel()] > 0.5) == bad).mean() > 0.9


def test_scores_on_held_out_rows(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, truth = [], {}
    for k in range(600):
        w = [word() if r.random() < 0.7 else r.choice(["the", "of", "and"]) for _ in range(80)]
        kind = k % 6
        if kind == 0:
            w = [x + "###" for x in w]
        elif kind == 1:
            w[5] = w[50] = "idiot"
        rows.append((k, " ".join(w), 0))
        truth[k] = (kind != 0, kind == 1)
    rows += [(None, "short", 0), (900, None, 0), (5, rows[5][1], 0)]
    labels = spark.createDataFrame([(k, int(q), int(t), 1) for k, (q, t) in truth.items() if k % 2] + [(2, None, None, 1), (None, 1, 0, 1)], "doc_id long, quality int, toxic int, text int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = weak_labels.score(docs, labels).collect()
    assert len(got) == len(rows)
    held = [x for x in got if x["doc_id"] in truth and x["doc_id"] % 2 == 0]
    wrong = [x["doc_id"] for x in held if x["kept"] != (truth[x["doc_id"]] == (True, False))]
    assert len(wrong) < 0.03 * len(held)
    assert weak_labels.score(docs.limit(0), labels).count() == 0
    assert weak_labels.score(docs, labels.limit(0)).count() == len(rows)


def test_classes_by_fingerprint_are_kept_as_one_and_the_rest_is_tested(spark):
    r = random.Random(8)
    say = lambda n: ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]
    base, family = say(60), say(200)
    texts = [" ".join(t) for t in [base, family + say(40), family + say(35), say(50), family, base]]
    # Thrice the same words: one fingerprint, though other shingles arise where the text meets itself.
    texts += [" ".join(base[:4] * 3), " ".join(base[:4] * 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = simhash_dedup.near_duplicates(df)
    by_print = {r["doc_id"]: r["component_id"] for r in start.collect()}
    alike, _ = similar_by_all_pairs(texts)
    want = groups_of([*alike, *by_print.items()], range(len(texts)))
    assert dict(simhash_dedup.similar_groups(df, Scratch(spark, "t"), start=start).collect()) == want
    # Groups that only the fingerprints know are kept as one, too.
    told = start.select("doc_id", F.when(F.col("doc_id") == 3, 0).otherwise(F.col("component_id")).cast("long").alias("component_id"))
    got = dict(simhash_dedup.similar_groups(df, Scratch(spark, "t"), start=told).collect())
    assert got == groups_of([*alike, *by_print.items(), (3, 0)], range(len(texts)))
    assert sorted(r["doc_id"] for r in simhash_dedup.keep_one(df).collect()) == sorted({g for g in want.values()})


def test_keep_one_asks_the_fingerprint_index(spark, docs, monkeypatch):
    asked = []
    inner = simhash_dedup.near_duplicates
    monkeypatch.setattr(simhash_dedup, "near_duplicates", lambda *a, **k: asked.append(1) or inner(*a, **k))
    simhash_dedup.keep_one(docs)
    assert asked


def test_staged_tables_have_few_files_where_partitions_are_not_coalesced(spark, monkeypatch):
    r = random.Random(9)
    say = lambda n: ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]
    base = say(200)
    texts = [" ".join(base[: 200 - 2 * k] + say(2 * k)) for k in range(20)] + [" ".join(say(50)) for _ in range(40)] + [" ".join(base)] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted({*similar_by_all_pairs(texts)[1].values()})
    files, inner = {}, Scratch.stage

    def staged(self, df, name, *a, **k):
        out = inner(self, df, name, *a, **k)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Scratch, "stage", staged)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {c: spark.conf.get(c) for c in held}
    try:
        for c, v in held.items():
            spark.conf.set(c, v)
        kept = simhash_dedup.keep_one(df)
        assert sorted(x["doc_id"] for x in kept.collect()) == want
        assert kept.rdd.getNumPartitions() <= 1 + df.rdd.getNumPartitions()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert max(files.values()) <= 3 and len(files) > 15, files
