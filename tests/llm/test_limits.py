"""Labels that teach nothing wrong, memory of long number texts, and TIFF files that ask for too much."""

import random
import re
import struct
import zlib

import pytest

from sigloom.llm import common, linededup, pii, tiff


def test_real_numbers_in_the_sample_dont_unteach_numbers(spark):
    """Picks a phone number whether or not the corpus is full of such numbers."""
    say = "words of a text here and there that say ring our office at {} now, and then go on with more words of it"
    sentence = "ring our office at (555) 010-1234 now"
    for number in ("(555) 010-%04d", "the long table %d"):
        docs = spark.createDataFrame([(i, say.format(number % i)) for i in range(300)], "doc_id long, text string")
        assert (3, 19, 33) in pii.fit(docs).pick(sentence, pii.base_spans(sentence))


def test_only_proven_examples_are_wrong():
    text = "on 2021-03-04 (555) 010-1234 and 1234 5678 9012 3456 or 999.1.1.1 4111 1111 1111 1111"
    wrong = {text[c[1] : c[2]] for c in pii.candidates(text, []) if pii.proven_wrong(text, c)}
    assert {"2021-03-04", "1234 5678 9012 3456", "999.1.1.1"} <= wrong and not {"(555) 010-1234", "4111 1111 1111 1111"} & wrong


def test_a_repeated_id_gives_one_picker(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} of a few words more than one and a number {i}{i}{i}") for i in range(160)], "doc_id long, text string")
    assert pii.fit(docs).thresholds == pii.fit(docs.repartition(5)).thresholds


def tiled(width, height, tile, data, compression):
    tags = [(256, 4, width), (257, 4, height), (258, 4, 8), (259, 4, compression), (277, 4, 1), (322, 4, tile), (323, 4, tile), (324, 4, 200), (325, 4, len(data))]
    head = b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    return head.ljust(200, b"\0") + data


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("tile", [4294967295, 65_535, 20_000])
def test_tiles_out_of_proportion_are_a_problem(compression, tile):
    (page,) = tiff.read_pages(tiled(4, 4, tile, zlib.compress(bytes(1000)), compression))
    assert page.problem and not page.pixels


def test_a_tile_may_be_larger_than_its_page():
    (page,) = tiff.read_pages(tiled(4, 4, 256, zlib.compress(bytes(range(256)) * 256), 8))
    assert not page.problem and page.pixels == bytes([0, 1, 2, 3] * 4)


def test_line_dedup_leaves_one_table(spark, tmp_path, monkeypatch):
    """Of the tables between its steps only the one that its result reads is left."""
    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(i, " ".join(f"word{k}" for k in range(i, 60 + i))) for i in range(4)], "doc_id long, text string")
    rest = [r.text.split() for r in linededup.drop_repeated_lines(docs).orderBy("doc_id").collect()]
    assert [len(x) for x in rest] == [60, 1, 1, 1]
    assert [p.name[:5] for p in tmp_path.iterdir()] == ["gone-"]


@pytest.mark.parametrize("run_words", [8, 9, 12, 35])
def test_line_dedup_of_few_words(spark, run_words):
    """Agrees with trying all runs, on texts of so few words that windows hold equal ones, and for runs of one window."""
    pick = random.Random(run_words)
    docs = [(i, " ".join(pick.choice("abc") * (1 + pick.random() * 2 > 2) + pick.choice("xyz") for _ in range(pick.randrange(150)))) for i in range(30)]
    docs += [(40 + i, f"{i} " + docs[i][1] + f" {i}") for i in range(8)]
    seen, want = set(), {}
    for i, text in docs:
        words, gone = text.split(), set()
        for k in range(len(words) - run_words + 1):
            run = tuple(words[k : k + run_words])
            gone |= set(range(k, k + run_words)) if run in seen else set()
            seen.add(run)
        want[i] = [w for k, w in enumerate(words) if k not in gone]
    got = linededup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), run_words=run_words, line_chars=10_000)
    assert {r.doc_id: r.text.split() for r in got.collect()} == want


def test_line_dedup_compiles_its_passes_over_words(spark, sf_dir):
    """Windows are read in compiled code: no array function with a lambda follows the words' hashes."""
    docs = linededup.named(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    plan = linededup.runs_of(docs, 35, 6)._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan.split("Generate explode")[0] and re.search(r"\*\(\d+\) Generate explode", plan)
