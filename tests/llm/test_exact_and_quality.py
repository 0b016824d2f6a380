"""Exact dedup and quality rules: SQL, brute force and awkward cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, quality, queries
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


TEXTS = [(0, "a  b"), (1, "a\tb"), (2, "a b "), (3, None), (4, ""), (5, "a b"), (5, "a b"), (6, "x" * 50_000), (7, "x" * 50_000), (None, "a b"), (8, "lone"), (9, "lone ")]


def docs_of(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, source string, _digest long")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    return groups


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda t: F.substring(exact_dedup.sha256_hex(t), 1, 1), lambda t: F.lit("same")])
def test_groups_equal_brute_force_even_where_digests_clash(spark, digest):
    found = exact_dedup.exact_groups(docs_of(spark), digest=digest, salts=3).collect()
    want = []
    for ids in brute(TEXTS).values():
        known = [i for i in ids if i is not None]
        keep, kept = (min(known) if known else None), False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            want.append((i, keep, len(ids), i == keep and not kept))
            kept = kept or i == keep
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found], key=key) == sorted(want, key=key)


def test_digest_is_of_the_normal_text(spark):
    found = {r.doc_id: r.digest for r in exact_dedup.exact_groups(docs_of(spark, [(1, "a \n b")])).collect()}
    assert found == {1: hashlib.sha256(b"a b").hexdigest()}


def test_dropping_keeps_columns_and_one_of_each_group(spark):
    docs = docs_of(spark)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(found) == len(brute(TEXTS)) and {i for i, _ in found} == {0, 2, 3, 6, 8, 9}


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0
    assert quality.quality(none).count() == 0


def repeats(words):
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = set()
    for k, g in enumerate(grams):
        if grams.count(g) > 1:
            covered |= {k, k + 1, k + 2}
    return len(covered)


def test_figures_equal_brute_force(spark):
    texts = [None, "", " \n\t", "a", "a b c", "a b c a b c", "a a a a a a", "x y z w x y z\nx y z\n\nq", "é ü ß é ü ß #*$ | <b>", "one two\none two\n one two\n", "w " * 400, "\x0b\x0c\rq  r s "]
    found = {r.doc_id: r for r in quality.quality(docs_of(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeats(words)), t
        assert r.base_failed and not r.kept


def test_clashing_hashes_are_told_apart_by_words(spark, monkeypatch):
    """With a hash of one value, every window clashes, and windows are compared by their words."""
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.lit(1 << 40).cast("long"))
    text = "a b c d e a b c f g h d e f"
    found = spark.createDataFrame([(text.split(),)], "w array<string>").select(quality.n_repeat_words(F.col("w"))).first()[0]
    assert found == repeats(text.split())


def test_lines_are_judged_first(spark):
    prose = "\n".join(" ".join(f"word{9 * k + j}" for j in range(9)) + "." for k in range(8))
    menu = "\n".join("Home | About | News | Contact | Help" for _ in range(8))
    odd = "\n".join(f"we{k}$$$ buy{k}*** all{k}%%% the{k}&&& things{k}### now$$$" for k in range(12))
    rows = {r.doc_id: r for r in quality.quality(docs_of(spark, [(1, prose), (2, prose + "\nHome | About\nAll rights reserved."), (3, menu + "\n" + prose), (4, odd)])).collect()}
    assert [rows[k].kept for k in (1, 2, 3, 4)] == [True, True, False, False]
    assert rows[2].clean_text == prose and rows[1].lost_chars == 0


def test_line_ends_do_not_change_a_verdict(spark):
    word = lambda k, letters: "".join(letters[(k * 7 + j * 3 + k // 5) % len(letters)] for j in range(2 + k % 5))
    lines = lambda letters, end: "\n".join(" ".join(word(12 * n + j * j, letters) for j in range(10)) + end for n in range(12))
    prose, scripts = lines("abcdefghijklmnopq", "."), {"ar": lines("ابتثجحخدذرزس", "؟"), "hi": lines("कखगघचछजझटठ", "।"), "zh": lines("这是文本的第行字词句", "。")}
    rows = [(k, t) for k, t in enumerate([prose, prose.replace("\n", "\r\n"), prose.replace("\n", "\t\n"), *scripts.values()])]
    found = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[k].kept for k in range(3)} == {True} and {r.lost_chars for r in found.values()} == {0}


def test_very_long_texts_of_one_line(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(60_000)) + "."), (2, "x" * 300_000)]
    found = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1].n_words, found[1].kept, found[2].n_words, found[2].base_failed) == (60_000, True, 1, True)
