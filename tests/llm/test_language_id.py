import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlens.llm import language_id as li
from hitlens.llm.queries import QUERIES

from .helpers import SF01, empty, frame, odd_rows, rows_of


def test_held_out_accuracy(spark):
    truth = {i: lang for i, _, lang, _ in rows_of(SF01)}
    texts = {i: t or "" for i, t, *_ in rows_of(SF01)}
    got = QUERIES["op5_language_id"](spark, SF01).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out and len(texts[r.doc_id]) > 40]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.accepted for r in held]) > 0.9 and all(0 <= r.score <= 1 for r in got)


def plain_fold(text):
    """Letters and marks in lower case, runs of others as one space, with a space at both ends."""
    out = " "
    for c in text.lower() + " ":
        c = c if unicodedata.category(c)[0] in "LM" else " "
        out += "" if c == " " and out[-1] == " " else c
    return out


def plain_model(rows):
    """Per language: counts of 4-grams, continuation counts below; and the number of characters of all languages."""
    langs = {}
    for text, lang in rows:
        folded = plain_fold(text)
        if any(c.isalpha() for c in folded):
            table = langs.setdefault(lang, Counter())
            table.update(folded[i : i + 4] for i in range(len(folded) - 3))
    out = {}
    for lang, four in langs.items():
        if four:
            out[lang] = {4: four}
            for order in (3, 2, 1):
                out[lang][order] = Counter(g[1:] for g in out[lang][order + 1])
    characters = {g for t in out.values() for g in t[1]}
    return out, len(characters) + 1


def probability(table, gram, uniform):
    """Interpolated Kneser-Ney, by its definition."""
    if not gram:
        return uniform
    inside = [n for g, n in table[len(gram)].items() if g[:-1] == gram[:-1]]
    lower = probability(table, gram[1:], uniform)
    if not inside:
        return lower
    return max(table[len(gram)].get(gram, 0) - 0.75, 0) / sum(inside) + 0.75 * len(inside) / sum(inside) * lower


TEXTS = [("abab cab! ba", "x"), ("ÄB ba", "x"), ("zzz a b", "y"), ("aa", "y"), ("漢字と仮名 漢字", "z"), ("12 !", "y"), ("a", "w")]
ASKED = ["abab", "cab ba zz", "漢字", "ÄÖ aab", "q", "a漢b", "", "  ", "12", "x" * 50, "ab " * 40, "é́a"]


@pytest.mark.parametrize("block_values", [1 << 23, 12])
def test_counts_and_entropies_against_the_definition(spark, block_values):
    """Also with a model cut into blocks."""
    rows = [(1 + 2 * i, t, lang, "s") for i, (t, lang) in enumerate(TEXTS)]
    rows = [(next(k for k in range(10 * i, 10 * i + 10) if zlib.crc32(str(k).encode()) % 5), t, lang, s) for i, (_, t, lang, s) in enumerate(rows, 1)]
    want, size = plain_model(TEXTS)
    got = {(r.lang, r.gram): r.n for r in li.counts(frame(spark, rows).select("lang", "text")).collect()}
    assert got == {(lang, g): n for lang, t in want.items() for g, n in t[4].items()}
    model = li.fit(frame(spark, rows))
    assert model.langs == sorted(want)
    docs = frame(spark, [(i, t, None, "s") for i, t in enumerate(ASKED)])
    found = {r.doc_id: r.language for r in li.predict(docs, model, block_values=block_values).collect()}
    for i, text in enumerate(ASKED):
        folded = plain_fold(text)
        if not any(c.isalpha() for c in folded):
            assert (found[i].lang, found[i].score, found[i].accepted) == ("und", 0.0, False)
            continue
        entropy = []
        for lang in model.langs:
            logs = [math.log(probability(want[lang], folded[max(0, k - 3) : k + 1], 1 / size)) for k in range(1, len(folded))]
            entropy.append(-sum(logs) / len(logs))
        best = min(entropy)
        assert abs(found[i].entropy - best) < 1e-4
        near = [lang for lang, e in zip(model.langs, entropy) if e < best + 1e-4]
        assert found[i].lang in near and 0 <= found[i].score <= 1
        odds = sum(math.exp((best - e) * 4 * math.sqrt(len(folded) - 1)) for e in entropy)
        assert abs(found[i].score - 1 / odds) < 1e-2


def test_languages_of_one_script_and_of_large_alphabets(spark):
    """Languages that differ by a few letters, and by ideographs alone."""
    rng = random.Random(4)
    stems = ["при", "мов", "сл", "дер", "город", "рек", "вод", "нов", "стар", "книг"]
    ends = {"ru": ["ы", "ый", "ого", "э", "ыё", "ъем"], "uk": ["і", "ій", "ого", "є", "ії", "ґа"], "bg": ["ът", "ата", "ове", "щя", "ия", "та"]}
    text = lambda lang: " ".join(rng.choice(stems) + rng.choice(ends[lang]) for _ in range(30))
    han = {"zh": [chr(0x4E00 + i) for i in range(0, 1200, 2)], "ja": [chr(0x4E00 + i) for i in range(1, 1200, 2)]}
    rows = [(i, text(lang), lang, "s") for i, lang in enumerate(["ru", "uk", "bg"] * 60)]
    rows += [(1000 + i, "".join(rng.choice(han[lang]) for _ in range(60)), lang, "s") for i, lang in enumerate(["zh", "ja"] * 60)]
    docs = frame(spark, rows)
    held = li.predict(docs, li.fit(docs)).filter(li.held_out(F.col("doc_id"))).collect()
    assert len(held) > 40 and np.mean([r.language.lang == r.lang for r in held]) > 0.97


def test_other_scripts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = li.fit(docs)
    model = li.calibrate(li.predict(docs, model), "lang", ~li.held_out(F.col("doc_id")), model)
    asked = frame(spark, [(1, "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία " * 5, None, "s"), (2, "12 !! ", None, "s")])
    got = {r.doc_id: r.language for r in li.predict(asked, model).collect()}
    assert got[1].lang in ("de", "en", "es", "fr") and not got[1].accepted and got[2].lang == "und"


def test_odd_rows_and_empty_table(spark):
    model = li.fit(frame(spark))
    got = li.predict(frame(spark).withColumn("language", F.lit("own")), model).collect()
    assert len(got) == len(odd_rows()) and {r.doc_id for r in got if r.language.lang == "und"} == {1, 2, 3}
    none = li.fit(empty(spark))
    assert none.langs == []
    assert {r.language.lang for r in li.predict(frame(spark), none).collect()} == {"und"}
    assert li.predict(empty(spark), model).count() == 0
