"""The corpus operators against brute force, on small tables with awkward rows."""

import collections
import hashlib
import pickle
import random
import re
import zlib

import pytest

pytest.importorskip("tessera.llm.registry")

from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import decontamination, near_dedup, packing, pii, quality_rules, rule_ensemble, token_counts, tokens, toxicity, url_filters, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    # Names that operators use for columns of their own.
    return df.withColumn("length", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("score", F.lit(None).cast("int")) if extra else df


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


AWKWARD = [(1, None), (2, ""), (3, "word"), (4, "word"), (4, "word"), (5, "é 日本 <|endoftext|> x" * 3), (None, "no id"), (6, prose(1, 20_000)), (7, " \n\t "), (8, "a" * 70_000)]


# Tokens and packing


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer
    import public_tokenizers

    slow, enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokens.encoder()
    texts = [t or "" for _, t in AWKWARD] + ["it's 12 o'clock!!  \n\n x", "<|endoftext|><|endoftext|>", "  lead", "trail  ", "  x 9½ ²", prose(3, 30_000)]
    for text, got in zip(texts, slow.encode_batch(texts, add_special_tokens=False), strict=True):
        assert tokens.encode(enc, text).tolist() == got.ids
        assert tokens.length(enc, text) == len(got.ids)


def test_parts_join_to_the_text():
    text = prose(2, 40_000)
    assert "".join(tokens.parts(text, 1000)) == text
    assert list(tokens.parts("x" * 5000, 1000)) == ["x" * 5000]
    r = random.Random(6)
    cyrillic = " ".join("".join(r.choice("абвгдежз") for _ in range(r.randint(1, 9))) for _ in range(30_000))
    chinese = "".join(r.choice("中文字符测试。，！") for _ in range(30_000))
    odd = "".join(r.choice(["a", "é", " ", "  ", "\n", "'s", "²", "_", "|", "<|endoftext|>", "endoftext|>", "日", "、", "!", "\x1c", " x y", "9"]) for _ in range(60_000))
    from tokenizers import Tokenizer
    import public_tokenizers

    slow, enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokens.encoder()
    for text in (cyrillic, chinese, odd):
        found = list(tokens.parts(text, 1000))
        assert "".join(found) == text and max(map(len, found)) < 1500
        assert [i for p in found for i in enc.encode(p, allowed_special="all")] == slow.encode(text, add_special_tokens=False).ids
    assert list(tokens.parts("")) == [""]


def test_token_counts(spark):
    enc = tokens.encoder()
    got = token_counts.count_tokens(docs_of(spark, AWKWARD, extra=True)).collect()
    want = sorted(((i, len((t or "").encode()), len(enc.encode(t or "", allowed_special="all"))) for i, t in AWKWARD), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.count_tokens(docs_of(spark, AWKWARD).limit(0)).count() == 0


def check_plan(histogram, capacity):
    plan = packing.plan_packing(histogram, capacity)
    fill = collections.defaultdict(list)
    for length, intervals in plan.intervals.items():
        for i, (rank, copies, sequence, offset) in enumerate(intervals):
            end = intervals[i + 1][0] if i + 1 < len(intervals) else plan.used[length]
            for k in range(end - rank):
                fill[sequence + k // copies].append((offset + k % copies * length, length))
    assert {k: v for k, v in plan.used.items() if v} == {k: v for k, v in histogram.items() if v}
    assert set(fill) == set(range(plan.n_sequences))
    for items in fill.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return plan.n_sequences


def test_plans_are_whole_and_tight():
    assert check_plan({}, 100) == 0
    assert check_plan({100: 3}, 100) == 3
    assert check_plan({51: 4, 49: 4}, 100) == 4
    assert check_plan({34: 6, 33: 3}, 100) == 4
    for seed in range(20):
        r = random.Random(seed)
        histogram = collections.Counter(r.randint(1, 100) for _ in range(r.choice([5, 50, 2000])))
        least = -(-sum(k * v for k, v in histogram.items()) // 100)
        assert check_plan(dict(histogram), 100) <= least * 1.07 + 3


def test_packing(spark):
    rows = AWKWARD + [(100 + i, prose(7, 30)) for i in range(300)]
    got = packing.pack(docs_of(spark, rows, extra=True)).collect()
    enc, want = tokens.encoder(), []
    for i, t in rows:
        ids = enc.encode(t or "", allowed_special="all") + [0]
        start, end, piece = 0, (len(ids) - 1) % 2048 + 1, 0
        while start < len(ids):
            want.append((i, piece, start, end - start, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[start:end]))))
            start, end, piece = end, end + 2048, piece + 1
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(docs_of(spark, rows).limit(0)).count() == 0


# Rules and personal data


def brute_quality(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())

    def covered(n):
        seen = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}

    longest = next((n for n in range(min(len(w), 60), 0, -1) if covered(n)), 0)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), len(b"".join(w).decode()), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered(3)), len(covered(10)), longest


def test_quality_measures_match_brute_force(spark):
    r = random.Random(5)
    texts = ["a b c a b c", "x " * 40, "l1 w\nl1 w\n\n \nq", "a b c\x1cd", "# $ <p>|", prose(4, 60) + "\n" + prose(4, 60)]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1, "x " * 40)]
    got = {(x.doc_id): x for x in quality_rules.quality_report(docs_of(spark, rows, extra=True)).collect()}
    for i, t in rows:
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.covered_words, x.longest_repeat) == brute_quality(t), t
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
        assert not (x.base_failed and x.kept)


def test_quality_verdict_and_filter(spark):
    good, once = prose(9, 400), prose(10, 40)
    bad = prose(11, 100) + " " + once + " " + prose(12, 20) + " " + once + " " + once
    docs = docs_of(spark, [(1, good), (2, bad), (3, "short"), (1, good)], extra=True)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [1, 1]


def brute_pii(t):
    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], ("email", "ip", "card", "phone").index(x[0])))


def test_base_spans_match_the_patterns():
    r = random.Random(3)
    texts = ["".join(r.choice("ab@.+-1 29%(é") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["a@b@c.d e@f.g.h-i j@k", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (411) 555-1507 +123", "x@y.z+w@v.u"]
    for t in texts:
        assert sorted(pii.base_spans(t), key=lambda x: (x[1], pii.ORDER[x[0]])) == brute_pii(t), t


def test_added_spans_need_checksum_or_context():
    kinds = lambda t: [s[0] for s in pii.spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert "iban" not in kinds("IBAN DE88 3704 0044 0532 0130 00.")
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("tel (411) 555-1507") == ["local_phone"] and kinds("(411) 555-1507") == []
    assert pii.spans("@" * 10_000) == [] and pii.spans("1" * 100_000) == [] and pii.spans("a" * 200_000 + "@") == []
    assert pii.mask("mail a@b.cd now") == "mail <email> now"


def test_pii_query(spark):
    rows = AWKWARD + [(20, "é a@b.co 10.0.0.1 x"), (21, "card 4111111111111111")]
    got = {r.doc_id: r for r in pii.find_pii(docs_of(spark, rows, extra=True)).collect()}
    assert len(got) == len({i for i, _ in rows})
    assert (got[20].n_email, got[20].n_ip, got[20].spans) == (1, 1, "email:2:8,ip:9:17")
    assert got[20].base_sha256 == hashlib.sha256(b"email:2:8,ip:9:17").hexdigest()
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""
    redacted = pii.redact(docs_of(spark, rows)).filter("doc_id = 21").first()
    assert redacted.text == "card <card>" and redacted.n_chars == len(redacted.text)


# Decontamination


def brute_hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        b = split(t)
        n = min(len(b), 10)
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", limit)
    a, b = prose(20, 40), prose(21, 12)
    items = [(1, a), (2, b), (3, "Short one"), (4, None), (5, "..."), (6, a), (10, "the the the the the the the the the the the")]
    w = a.split()
    rows = [(1, prose(30, 30) + " " + a.upper() + " tail"), (2, " ".join(w[5:14])), (3, " ".join(w[5:15])), (4, "É " + b + "! " + b), (5, "a SHORT, one b short one"), (6, None), (7, ""), (8, "the " * 30), (1, prose(30, 30) + " " + a.upper() + " tail"), (1, "other text of id one"), (9, "Kelvin K é Short ONE")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs_of(spark, rows, extra=True), bench).collect()
    want = sorted((i, *brute_hits(t, items)) for i, t in rows)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    kept = decontamination.drop_contaminated(docs_of(spark, rows, extra=True), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in rows if not brute_hits(t, items)[1])
    assert decontamination.contamination(docs_of(spark, rows).limit(0), bench).count() == 0
    clean = decontamination.contamination(docs_of(spark, rows), bench.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r.contaminated for r in clean)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination_finds_rows_without_an_id(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", limit)
    passage = prose(22, 40)
    docs = docs_of(spark, [(None, passage), (None, prose(23, 40)), (1, passage), (2, prose(24, 40))])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = decontamination.contamination(docs, bench).collect()
    assert sorted((r.doc_id is None, r.n_hit, r.contaminated) for r in got) == [(False, 0, False), (False, 40, True), (True, 0, False), (True, 40, True)]
    assert sorted(str(r.doc_id) for r in decontamination.drop_contaminated(docs, bench).collect()) == ["2", "None"]


def test_decontamination_of_long_texts(spark):
    """100,000 words with a passage at each end, and a text of one repeated word that an item repeats, too."""
    passage, filler = prose(24, 30), prose(25, 100_000)
    items = [(1, passage), (2, "so " * 40), (3, prose(26, 300))]
    rows = [(1, passage + " " + filler + " " + passage), (2, "so " * 20_000), (3, filler), (4, prose(26, 300) + " x " + prose(26, 299))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contamination(docs_of(spark, rows), bench).collect()}
    assert [(got[i].n_hit, got[i].n_items) for i in (1, 2, 3, 4)] == [(60, 1), (20_000, 1), (0, 0), (599, 1)]
    assert [(s.start, s.end) for s in got[1].spans] == [(0, 30), (100_030, 100_060)]


# Near-duplicates


def edited(text, seed, n):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        i = r.randrange(len(w))
        w[i : i + r.randint(0, 1)] = [f"edit{r.randrange(10**9)}"]
    return " ".join(w)


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_similar(a, b):
    a, b = (a or "").lower().split(), (b or "").lower().split()
    n = max(len(a), len(b))
    return abs(len(a) - len(b)) <= 0.2 * n and brute_edits(a, b) <= 0.2 * n + 1e-9


def brute_classes(rows):
    texts = dict(rows)
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if root(i) != root(j) and brute_similar(texts[i], texts[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_banded_alignment_is_the_edit_distance(monkeypatch):
    import numpy as np

    r = random.Random(1)
    for band in (1, 3, 32):
        monkeypatch.setattr(near_dedup, "BAND", band)
        for _ in range(700):
            a = [r.randrange(r.choice([2, 6, 40])) for _ in range(r.randint(0, 40))]
            b = list(a)
            for _ in range(r.randint(0, 12)):
                i = r.randrange(len(b) + 1)
                b[i : i + r.randint(0, 2)] = [r.randrange(9) for _ in range(r.randint(0, 2))]
            want, most = brute_edits(a, b), r.randint(0, 20)
            x, y = np.array(a, np.int32), np.array(b, np.int32)
            assert near_dedup.edits_within(x, y, most) == (want if want <= most else None)
            assert near_dedup.similar(x, y) == (want <= 0.2 * max(len(a), len(b)) + 1e-9)


def replaced(words, seed, share):
    """``words`` with so many of them replaced, at random places."""
    r, w = random.Random(seed), list(words)
    for i in r.sample(range(len(w)), round(share * len(w))):
        w[i] = f"new{r.randrange(10**9)}"
    return w


def test_sketches_find_near_copies():
    """The share of pairs that a sketch finds, by the share of words replaced at random; 0.2 is the threshold."""
    from tessera.llm.near_dedup import sketches, word_hashes

    for share, least in ((0.02, 1), (0.05, 1), (0.1, 0.99), (0.15, 0.95), (0.2, 0.7)):
        found = []
        for seed in range(200):
            words = prose(seed, random.Random(seed).randint(40, 400)).split()
            a, b = sketches([word_hashes(" ".join(x)) for x in (words, replaced(words, seed, share))])
            found.append(bool(set(a.tolist()) & set(b.tolist())))
        assert sum(found) / len(found) >= least, share


def test_near_copies_of_a_population_are_found(spark):
    """Recall over planted near copies, among texts that share one long passage."""
    passage = prose(900, 60)
    rows, pairs = [], []
    for i in range(150):
        words = prose(1000 + i, random.Random(i).randint(80, 250)).split()
        words = words + passage.split() if i % 2 else words
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(replaced(words, i, 0.04 + 0.01 * (i % 12))))]
        pairs.append((2 * i, 2 * i + 1))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)
    want = brute_classes(rows[:24])
    assert all(got[i] == got[j] for i in want for j in want if want[i] == want[j])
    assert len(set(got.values())) >= 150


def test_large_buckets_lose_no_near_copies(spark, monkeypatch):
    """Buckets beyond the pairwise limit, many of whose members only share a passage."""
    monkeypatch.setattr(near_dedup, "PAIRWISE", 3)
    passage, base = prose(901, 80), prose(902, 120)
    rows = [(i, prose(2000 + i, 60) + " " + passage) for i in range(40)]
    rows += [(100 + i, " ".join(replaced((prose(2000 + i, 60) + " " + passage).split(), i, 0.08))) for i in range(40)]
    rows += [(200 + i, " ".join(replaced(base.split(), i, 0.06))) for i in range(40)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert all(got[100 + i] == i for i in range(40))
    assert {got[200 + i] for i in range(40)} == {200}


def test_pairs_that_share_only_large_buckets_are_found(spark, monkeypatch):
    """Near copies whose only common k-mers lie in a passage that all texts have."""
    monkeypatch.setattr(near_dedup, "PAIRWISE", 3)
    passage, rows = prose(903, 100), []
    for i in range(40):
        own = [f"own{i}x{k}" for k in range(40)]
        other = [f"new{i}x{k}" if k % 5 == 2 else w for k, w in enumerate(own)]
        rows += [(i, " ".join(own) + " " + passage), (100 + i, " ".join(other) + " " + passage)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {j: i for i in range(40) for j in (i, 100 + i)}


def test_pipeline_stage_keeps_one_of_pairs_in_large_buckets(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    monkeypatch.setattr(near_dedup, "PAIRWISE", 3)
    passage, rows = prose(903, 100), []
    for i in range(40):
        own = [f"own{i}x{k}" for k in range(40)]
        rows += [(i, " ".join([*own, passage])), (100 + i, " ".join([*(f"new{i}x{k}" if k % 5 == 2 else w for k, w in enumerate(own)), passage]))]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs_of(spark, rows), str(tmp_path)).collect()) == list(range(40))


def test_meetings_lose_no_near_copies(spark):
    """Of few words, short and long, under any order of the words."""
    import numpy as np

    r, texts = random.Random(5), {}
    for i in range(30):
        texts[i] = [r.randrange(r.choice([4, 30])) for _ in range(r.randint(1, 60))]
        near = list(texts[i])
        for _ in range(r.randint(0, len(near) // 4)):
            at = r.randrange(len(near) + 1)
            near[at : at + r.randint(0, 2)] = [r.randrange(40) for _ in range(r.randint(0, 1))]
        texts[100 + i] = near or [1]
    rows = spark.createDataFrame(list(texts.items()), "id long, words array<int>")
    rare = near_dedup.rare_words(rows)
    alone = spark.createDataFrame([], "id long, component long")
    got = {(p.a, p.b) for p in near_dedup.meetings(rare, alone).collect()}
    words = {i: np.array(w, np.int32) for i, w in texts.items()}
    assert got >= {(i, j) for i in words for j in words if i < j and near_dedup.similar(words[i], words[j])}
    one = spark.createDataFrame([(i, 0) for i in texts], "id long, component long")
    assert not near_dedup.meetings(rare, one).count()


def test_texts_that_only_share_a_passage_meet_no_others(spark):
    """Those without enough pairs of words in other components are put aside; no near copy is, of few words or many."""
    import numpy as np

    r, passage, texts = random.Random(7), [10**6 + k for k in range(40)], {}
    for i in range(60):
        texts[i] = [r.randrange(10**5) for _ in range(80)] + passage
    for i in range(1, 40):
        texts[1000 + i] = [r.randrange(5000) for _ in range(i)]
        near = list(texts[1000 + i])
        for _ in range(i // 5):
            at = r.randrange(len(near) + 1)
            near[at : at + r.randint(0, 1)] = [r.randrange(5000) for _ in range(r.randint(0, 1))]
        texts[2000 + i] = near or [1]
    rows = spark.createDataFrame([(i, w, i) for i, w in texts.items()], "id long, words array<int>, component long")
    left = near_dedup.plausible(rows)
    words = {i: np.array(w, np.int32) for i, w in texts.items()}
    near = {(i, i + 1000) for i in words if 1000 <= i < 2000 and near_dedup.similar(words[i], words[i + 1000])}
    got = {x.id for x in left.collect()}
    assert len(near) > 25 and got >= {i for pair in near for i in pair} and not any(i < 60 for i in got)
    alone = spark.createDataFrame([], "id long, component long")
    pairs = near_dedup.meetings(near_dedup.rare_words(left), alone).collect()
    assert near <= {(p.a, p.b) for p in pairs}
    # What tells few texts apart asks for few rows: one for each rare word that another text has, too.
    assert near_dedup.rare_words(rows.filter("id < 60")).agg({"n": "count"}).first()[0] == 60
    assert sum(len(x.rare) for x in near_dedup.rare_words(rows.filter("id < 60")).collect()) < 600
    one = rows.withColumn("component", F.lit(0).cast("long"))
    assert not near_dedup.plausible(one).count()


def test_near_duplicates_match_brute_force(spark):
    base, short = prose(40, 300), prose(41, 14)
    rows = [(i, edited(base, i, i % 7)) for i in range(2, 60)] + [(100, base), (101, base), (102, base)]
    rows += [(200 + i, prose(50 + i, 120)) for i in range(20)] + [(300, short), (301, short + " more"), (302, short), (303, "two words"), (304, "two words"), (305, "two other")]
    rows += [(400, None), (401, ""), (402, prose(60, 400) + " " + base[:300]), (100, base), (403, "Two  WORDS"), (404, prose(61, 5_000)), (405, prose(61, 5_000) + " end")]
    got = near_dedup.near_duplicates(docs_of(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    want = brute_classes(dict(rows).items())
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.copy_of == min(i for i, t in rows if (t or "") == (dict(rows)[r.doc_id] or "")) for r in got)
    kept = near_dedup.keep_first(docs_of(spark, rows + [(None, "kept"), (None, "kept")]))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*set(want.values()), None, None], key=str)
    assert near_dedup.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (70, 70)]
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 55: 50, 60: 50}


# Classifiers


def test_rule_ensemble_finds_a_conjunction():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.random((2000, len(rule_ensemble.NAMES)))
    y = ((x[:, 2] > 0.5) & (x[:, 4] <= 0.7)).astype(float)
    model = rule_ensemble.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert len(model.rules) < 120
    assert rule_ensemble.fit(x[:3], y[:3]).rules == []


def test_column_scores_are_the_models(spark):
    import numpy as np

    model = rule_ensemble.Ensemble(0.3, [(((0, 2.0, True), (2, 0.1, False)), 1.5), (((5, 0.05, True),), -2.0)])
    stats = rule_ensemble.with_statistics(docs_of(spark, AWKWARD, extra=True))
    rows = stats.select("*", model.column().alias("__score")).collect()
    x = np.array([[r[n] for n in rule_ensemble.NAMES] for r in rows], float)
    assert np.allclose(model.score(x), [r["__score"] for r in rows])


def test_statistics_match_plain_python(spark):
    import math

    def plain(t):
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        lines = [x for x in t.split("\n") if x]
        n, c, per = max(len(w), 1), max(len(t), 1), lambda chars: sum(t.count(x) for x in chars) / max(len(w), 1)
        import regex

        return [math.log1p(len(w)), len(t) / n, per("#*$%&|<>{}=_~^\\"), per("!?"), per(".,;:"), len(regex.findall(r"\p{Lu}", t)) / c, len(re.findall("[0-9]", t)) / c, len(set(w)) / n, len(w) / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), math.log1p(max(map(len, w), default=0))]

    rows = [*AWKWARD, (50, "Ab, ab! 12\n\nx_y\nx_y"), (51, "# $ ÄÖ? \x0b z")]
    got = rule_ensemble.with_statistics(docs_of(spark, rows, extra=True)).collect()
    want = sorted(((i, *plain(t)) for i, t in rows), key=str)
    for a, b in zip(sorted((tuple(r) for r in got), key=str), want, strict=True):
        assert a[0] == b[0] and all(abs(x - y) < 1e-9 for x, y in zip(a[1:], b[1:], strict=True)), (a, b)


def test_lasso_reaches_the_optimum():
    """The conditions of the optimum: a gradient of at most the penalty, and equal to it where a weight isn't zero."""
    import numpy as np

    r = np.random.default_rng(3)
    x = (r.random((400, 12)) < r.random(12)).astype(float)
    y = (r.random(400) < 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1] - 0.5)))).astype(float)
    for penalty, (w, b) in zip((0.05, 0.02, 0.01), rule_ensemble.lasso(x, y, np.array([0.05, 0.02, 0.01]), steps=4000), strict=True):
        mean = x.mean(0)
        scale = np.sqrt(mean * (1 - mean)) + 1e-3
        z = (x - mean) / scale
        slope = z.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        assert (np.abs(slope) <= penalty + 1e-4).all()
        on = np.abs(w) > 1e-6
        assert np.allclose(slope[on], -penalty * np.sign(w[on]), atol=1e-3) and on.any()


def test_quality_classifier_on_odd_tables(spark):
    docs, labels, _ = labelled_docs(spark, 120)
    model = rule_ensemble.train(docs, labels)
    assert rule_ensemble.score_quality(docs.limit(0), model).count() == 0
    assert {r.score for r in rule_ensemble.score_quality(docs.limit(5), rule_ensemble.train(docs.limit(0), labels)).collect()}
    wide = docs.withColumn("y", F.lit("x")).withColumn("score", F.lit("x")).withColumn("quality", F.lit(7))
    assert sorted(r.score for r in rule_ensemble.score_quality(wide, rule_ensemble.train(wide, labels)).collect()) == sorted(r.score for r in rule_ensemble.score_quality(docs, model).collect())


def labelled_docs(spark, n=400):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 7 == 0
        w = prose(i + 500, r.randint(30, 80)).split()
        if toxic:
            w[3] = w[9] = r.choice(["vilea", "vileb", "vilec"])
        rows.append((i, " ".join(x + "$$$" if bad else x for x in w)))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(0, None, None), (1, 1, None), (None, 1, 1), (2, 1, 0), (2, 1, 0)]
    return docs_of(spark, rows + AWKWARD), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), n


def test_quality_classifier(spark):
    docs, labels, n = labelled_docs(spark)
    got = rule_ensemble.score_quality(docs, rule_ensemble.train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 10 and r.doc_id < n]
    assert sum(r.predicted == (r.doc_id % 5 != 0) for r in test) / len(test) > 0.9
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    none = rule_ensemble.score_quality(docs, rule_ensemble.train(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}


def test_toxicity_is_exact_and_learns(spark):
    import numpy as np

    docs, labels, n = labelled_docs(spark)
    index = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(docs, index).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 10 and r.doc_id < n]
    assert sum(r.predicted == (r.doc_id % 7 == 0) for r in test) / len(test) > 0.9
    # Block-max search against the whole matrix.
    whole = np.zeros((len(index.ids), len(index.terms)))
    for i in range(len(index.ids)):
        at = slice(index.starts[i], index.starts[i + 1])
        whole[i, index.numbers[at]] = index.unit[at]
    for r in docs.limit(60).collect():
        terms, weights = index.vector(r.text)
        cosine = whole[:, terms] @ weights if len(terms) else np.zeros(len(whole))
        want = sorted((c for c in cosine if c > 0), reverse=True)[: index.k]
        at, near = index.nearest(terms, weights) if len(terms) else ([], [])
        assert np.allclose(near, want)
    blank = toxicity.score_toxicity(docs, toxicity.train(docs, labels.filter("toxic = 0"))).collect()
    assert len({r.score for r in blank}) == 1


def test_blocks_are_passed_over_without_losing_neighbours(monkeypatch):
    """Texts of several vocabularies: most blocks are passed over, and the nearest are those of the whole matrix."""
    import numpy as np

    monkeypatch.setattr(toxicity, "BLOCK", 8)
    r = random.Random(5)
    books = [[f"{c}{i}" for i in range(60)] for c in "abcd"]
    texts = [r.choices(books[i % 4], weights=range(60, 0, -1), k=r.randint(10, 80)) for i in range(400)]
    df = collections.Counter(w for t in texts for w in set(t))
    terms = sorted(df, key=lambda w: (-df[w], w))
    number, idf = {w: i for i, w in enumerate(terms)}, np.array([np.log(400 / df[w]) + 1 for w in terms])
    examples = [(i, i % 2, *map(np.array, zip(*sorted(collections.Counter(number[w] for w in t).items())))) for i, t in enumerate(texts[:300])]
    examples = [(i, y, t.astype(np.int32), c.astype(np.int32)) for i, y, t, c in examples]
    index = toxicity.build_index(terms, idf, np.zeros(len(terms), bool), examples, (1.0, 1.0), k=5)
    whole = np.zeros((300, len(terms)))
    for i, _, t, c in examples:
        whole[i, t] = (1 + np.log(c)) * idf[t]
    whole /= np.sqrt((whole * whole).sum(axis=1))[:, None]
    queries = [index.vector(" ".join(t)) for t in texts[300:]]
    monkeypatch.setattr(toxicity, "TOGETHER", 1)
    assert index.dense and (index._near(queries, [-1] * 100) == -1).mean() > 0.3
    for (terms_of, weights), (at, cosine) in zip(queries, index.search(queries), strict=True):
        every = whole[:, terms_of] @ weights
        want = np.lexsort((np.arange(300), -every))[:5]
        assert index.ids[at].tolist() == want.tolist() and np.allclose(cosine, every[want])


def test_toxicity_words_are_those_of_the_pattern():
    texts = ["".join(map(chr, range(128))), "Don't_stop 42\x1c\x1f\x0b\tEND", "\x00a\x85b", "Été İstanbul ß\u2028x", "", None, " .,"]
    texts += [f"a{chr(i)}B" for i in range(0x3000)]
    for text in texts:
        assert toxicity.words(text) == re.findall(r"\w+", (text or "").lower())
    assert toxicity._ASCII[ord("A")] == ord("a") and toxicity._ASCII[ord("-")] == ord(" ")


def test_toxicity_on_odd_tables(spark):
    docs, labels, _ = labelled_docs(spark, 150)
    index = toxicity.train(docs, labels)
    assert toxicity.score_toxicity(docs.limit(0), index).count() == 0
    none = toxicity.score_toxicity(docs.limit(3), toxicity.train(docs.limit(0), labels)).collect()
    assert len(none) == 3 and len({r.score for r in none}) == 1
    wide = docs.withColumn("toxic", F.lit("x")).withColumn("term", F.lit("x")).withColumn("n", F.lit(7))
    both = [{(r.doc_id, r.score, *r.neighbours) for r in toxicity.score_toxicity(d, toxicity.train(d, labels)).collect()} for d in (docs, wide)]
    assert both[0] == both[1]
    # Copies of an example: its smallest id stands for them, so that ties and evidence are the same in every run.
    few = docs.filter("doc_id >= 10")
    source, twin = (next(i for i in some if zlib.crc32(str(i).encode()) % toxicity.FOLDS != toxicity.HELD_OUT) for some in (range(14, 150, 7), range(5000, 5100)))
    twice = few.filter(F.col("doc_id") == source).withColumn("doc_id", F.lit(twin).cast("long")).union(few)
    ids = toxicity.train(twice, labels.union(spark.createDataFrame([(twin, 1, 1)], labels.schema))).ids.tolist()
    assert source in ids and twin not in ids


def test_toxicity_indexes_all_terms_of_the_examples(spark):
    import math
    from collections import Counter

    docs, labels, n = labelled_docs(spark)
    # Toxic by words that nothing else has, so that no selection by frequency keeps them.
    odd = next(i for i in range(5000, 5100) if zlib.crc32(str(i).encode()) % toxicity.FOLDS != toxicity.HELD_OUT)
    docs = docs.filter("doc_id >= 10").union(docs_of(spark, [(odd, "zyx wvut zyx"), (7001, "zyx wvut zyx")]))
    labels = labels.union(spark.createDataFrame([(odd, 1, 1)], labels.schema))
    index = pickle.loads(pickle.dumps(toxicity.train(docs, labels)))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, index).collect()}
    assert got[7001].neighbours == [odd] and abs(got[7001].cosines[0] - 1) < 1e-9
    # Full TF-IDF cosine, without the index.
    texts = {r.doc_id: r.text for r in docs.collect()}
    every = [set(toxicity.words(r.text)) for r in docs.collect()]
    df = Counter(w for s in every for w in s)
    known = {w for i in index.ids.tolist() for w in toxicity.words(texts[i])}
    assert set(index.terms) == known

    def vector(text):
        w = {t: (1 + math.log(c)) * (math.log((1 + len(every)) / (1 + df[t])) + 1) for t, c in Counter(toxicity.words(text)).items() if t in known}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / length for t, x in w.items()}

    examples = [vector(texts[i]) for i in index.ids.tolist()]
    for i in list(texts)[:25]:
        q = vector(texts[i])
        want = sorted((c for x in examples if (c := sum(q[t] * x.get(t, 0) for t in q)) > 0), reverse=True)[: index.k]
        assert len(want) == len(got[i].cosines) and all(abs(a - b) < 1e-9 for a, b in zip(want, got[i].cosines, strict=True))


# URL filters and WARC


def test_url_filters(spark):
    entries = [("l", "block", "bad.org", "add", "2024-01-10"), ("l", "block", "bad.org", "add", "2024-01-12"), ("l", "block", "bad.org", "remove", "2024-02-01"), ("l", "block", "x.com/a", "add", "2024-01-01"), ("ok", "allow", "x.com/a/b", "add", "2024-01-01"), ("l", "block", None, "add", "2024-01-01"), ("l", "block", "both.org", "add", "2024-01-01"), ("l", "block", "both.org", "remove", "2024-01-01")]
    captures = [(1, "https://www.bad.org/x", "2024-01-11"), (2, "http://a.bad.org:80/", "2024-02-01"), (3, "http://X.com/a?q", "2024-01-01"), (4, "http://x.com/a/b/c", "2024-01-02"), (5, "http://x.com/ab", "2024-01-02"), (6, None, "2024-01-02"), (7, "nonsense", "2024-01-02"), (8, "http://bad.org/", None), (9, "http://both.org", "2024-01-02"), (1, "https://www.bad.org/x", "2024-01-11"), (10, "http://bad.org", "2024-01-09")]
    e = spark.createDataFrame(entries, "list string, kind string, key string, action string, day string").withColumn("day", F.col("day").cast("timestamp"))
    c = spark.createDataFrame(captures, "page_id long, url string, fetch_time string").withColumn("fetch_time", F.col("fetch_time").cast("timestamp"))
    for few in (200_000, -1):
        url_filters.BROADCAST_ROWS, old = few, url_filters.BROADCAST_ROWS
        got = url_filters.filter_urls(c, e).collect()
        url_filters.BROADCAST_ROWS = old
        assert sorted(r.page_id for r in got) == sorted(x[0] for x in captures)
        assert {r.page_id for r in got if r.blocked} == {1, 3}
        assert {r.page_id: r.rule for r in got}[4] == "x.com/a/b"
    assert url_filters.filter_urls(c.limit(0), e).count() == 0
    assert not any(r.blocked for r in url_filters.filter_urls(c, e.limit(0)).collect())


@pytest.mark.parametrize("few", [200_000, -1])
def test_url_keys_count_whole(spark, monkeypatch, few):
    monkeypatch.setattr(url_filters, "BROADCAST_ROWS", few)
    long = "x.com/" + "a" * 300
    entries = [(f"{long}/b", "add", "2024-01-01"), (f"{long}/c", "add", "2024-01-01"), (f"{long}/c", "remove", "2024-01-05")]
    captures = [(1, f"http://{long}/b/d/e"), (2, f"http://{long}/c"), (3, f"http://{long}a/b"), (4, f"http://{long}"), (5, f"http://{long}/bb")]
    e = spark.createDataFrame([("l", "block", *x) for x in entries], "list string, kind string, key string, action string, day string").withColumn("day", F.col("day").cast("timestamp"))
    c = spark.createDataFrame(captures, "page_id long, url string").withColumn("fetch_time", F.lit("2024-01-10").cast("timestamp"))
    got = {r.page_id: (r.n_rules, r.rule, r.blocked) for r in url_filters.filter_urls(c, e).collect()}
    assert got == {1: (1, f"{long}/b", True)} | {i: (0, None, False) for i in (2, 3, 4, 5)}


def test_long_urls_and_odd_columns(spark):
    """100,000 path segments against short keys, a listed key that ends inside them, and columns with names of the operator's own."""
    path = "/".join(f"s{i % 97}" for i in range(100_000))
    e = spark.createDataFrame([("l", "block", "x.com/s0/s1/s2", "add", "2024-01-01"), ("l", "block", "deep.a.b.c.org", "add", "2024-01-01")], "list string, kind string, key string, action string, day string").withColumn("day", F.col("day").cast("timestamp"))
    rows = [(1, f"http://x.com/{path}"), (2, f"http://x.com/s0/s1x/{path}"), (3, "http://" + "z." * 5000 + "deep.a.b.c.org/" + path), (4, "http://a.b.c.org/")]
    c = spark.createDataFrame(rows, "page_id long, url string").withColumn("fetch_time", F.lit("2024-01-10").cast("timestamp")).withColumn("key", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("host", F.lit("y"))
    got = {r.page_id: (r.rule, r.blocked) for r in url_filters.filter_urls(c, e).collect()}
    assert got == {1: ("x.com/s0/s1/s2", True), 2: (None, False), 3: ("deep.a.b.c.org", True), 4: (None, False)}


def test_warc_round_trip(spark, tmp_path):
    import base64

    pages = [(1, "http://a/", "<p>é</p>\r\n\r\nx"), (2, "http://b/", "<p>é</p>\r\n\r\nx"), (3, "http://c/", None), (4, "http://d/", ""), (5, None, "y" * 100_000), (6, "http://e/", "<p>é</p>\r\n\r\nx"), (1, "http://a/", "<p>é</p>\r\n\r\nx")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    warc.write_archive(df, f"{tmp_path}/a")
    got = warc.read_archive(spark, f"{tmp_path}/a").collect()
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        first = min(p for p, _, x in pages if (x or "") == (h or ""))
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == 3
    warc.export(spark, f"{tmp_path}/a", f"{tmp_path}/files")
    back = {(r.header, bytes(r.block)) for r in warc.read_files(spark, f"{tmp_path}/files").collect()}
    assert back == {(r.header, bytes(r.block)) for r in warc.reconstruct(spark, f"{tmp_path}/a").collect()}
    assert {bytes(r.payload) for r in warc.reconstruct(spark, f"{tmp_path}/a").collect()} == {(h or "").encode() for _, _, h in pages}
    empty = df.limit(0)
    warc.write_archive(empty, f"{tmp_path}/b")
    assert warc.read_archive(spark, f"{tmp_path}/b").count() == 0


def brute_pipeline(rows, items):
    """Stages 1 to 4 on (doc_id, text): the ids and texts that are left."""
    def keeps(t):
        n, _, _, _, windows, covered, longest = brute_quality(t)
        return not (n < 50 or 100 * windows > 50 * n or covered > 0.3 * n or (longest >= 10 and longest > 0.2 * n))

    left = [(i, t) for i, t in rows if keeps(t)]
    named = [(i, t) for i, t in left if i is not None]
    # Rows of one id are one document; rows without an id are in no class.
    classes = brute_classes(dict(named).items())
    first = {i: t for i, t in reversed(named) if classes[i] == i}
    left = [*first.items(), *((i, t) for i, t in left if i is None)]
    left = [(i, t) for i, t in left if not brute_hits(t, items)[1]]
    return sorted(((i, pii.mask(t)) for i, t in left), key=str)


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline

    r, passage, shared = random.Random(77), prose(300, 30), prose(301, 60)
    rows = [(1000 + i, prose(400 + i, r.randint(20, 160))) for i in range(40)]
    rows += [(1100 + i, " ".join(replaced(rows[i][1].split(), i, 0.05 * (i % 4)))) for i in range(0, 40, 3)]
    rows += [(200 + i, prose(500 + i, 70) + " " + passage) for i in range(4)] + [(210 + i, prose(520 + i, 80) + " " + shared) for i in range(6)]
    rows += [(220, "mail a@b.co or call +1 411 555 1507 " + prose(600, 90)), (221, "same words " * 90), (222, prose(601, 40) + (" " + prose(602, 30)) * 4)]
    rows += [*AWKWARD, (None, prose(603, 100)), (None, prose(603, 100)), rows[0], rows[5]]
    items = [(1, passage), (2, "two words"), (3, None)]
    for name, table in (("some", rows), ("none", [])):
        docs_of(spark, table, extra=True).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        columns = docs.columns
        for stage, (_, function) in enumerate(corpus_pipeline.STAGES[:-1]):
            function(spark, docs, f"{tmp_path}/{name}").write.parquet(f"{tmp_path}/{name}/stage{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/stage{stage}")
            assert docs.columns == columns
        got = sorted(((x.doc_id, x.text) for x in docs.collect()), key=str)
        want = brute_pipeline(table, items)
        assert got == want
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, f"{tmp_path}/{name}").collect()
        assert collections.Counter(x.doc_id for x in packed if x.piece == 0) == collections.Counter(i for i, _ in got)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = prose(70, 200)
    rows = [(1, base), (2, edited(base, 1, 1)), (3, prose(71, 100) + " " + prose(99, 30)), (4, prose(72, 100) + " a@b.co"), (5, "short"), (6, prose(73, 150)), (7, None)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(99, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in docs.collect()) == [1, 4, 6]
    assert docs.filter("doc_id = 4").first().text.endswith("<email>")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 4, 6}
