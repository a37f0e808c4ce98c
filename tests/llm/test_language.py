"""Language of texts against plain sets of n-grams."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from paperloom.llm import language


def plain_grams(text):
    """Three letters in a row, where a word's edge counts as one."""
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    return [(" " + w + " ")[i : i + 3] for w in words for i in range(len(w))]


def plain_languages(rows):
    """``(id, held out, languages, scores)`` of ``(id, text, lang)`` by counting with sets.

    Several languages are equal but for the correction of their false positives.
    """
    held_out = {name: zlib.crc32(str(name).encode()) % 3 == 1 for name, _, _ in rows}
    counts, sizes = defaultdict(Counter), Counter()
    for name, text, lang in rows:
        if text is not None and lang is not None and not held_out[name]:
            counts[lang].update(plain_grams(text))
            sizes[lang] += 1
    order = sorted(sizes, key=lambda lang: (-sizes[lang], lang))
    often = {lang: {g for g, n in counts[lang].items() if n >= language.SHARE * sum(counts[lang].values())} for lang in order}
    out = []
    for name, text, _ in rows:
        found = plain_grams(text)
        if not found or not order:
            out.append((name, held_out[name], ["und"], [0.0]))
            continue
        every = [sum(g in counts[lang] for g in found) / len(found) for lang in order]
        both = [e + sum(g in often[lang] for g in found) / len(found) for e, lang in zip(every, order)]
        best = [i for i, value in enumerate(both) if value > max(both) - 1e-6]
        best = best[:1] if max(both) in (0, 2) else best  # nothing to correct: the most common language
        out.append((name, held_out[name], [order[i] for i in best], [every[i] for i in best]))
    return out


@pytest.mark.parametrize("share", [1e-4, 0.02])
def test_query_against_sets(spark, monkeypatch, share):
    monkeypatch.setattr(language, "SHARE", share)
    monkeypatch.setattr(language.learn, "__kwdefaults__", language.learn.__kwdefaults__ | {"share": share})
    rng = random.Random(8)
    syllables = {"aa": ["ba", "do", "ki", "an"], "bb": ["öx", "um", "an", "do"], "cc": ["zz", "qu", "ba", "um"]}
    rows = []
    for i in range(400):
        lang = rng.choice(list(syllables))
        sounds = syllables[lang] if rng.random() < 0.8 else [rng.choice(s) for s in syllables.values()]
        words = ["".join(rng.choice(sounds) for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice([1, 2, 3, 40]))]
        rows.append((i, rng.choice([" ", ", ", "\n", "3"]).join(words), lang if rng.random() < 0.9 else None))
    # Ties, repeated rows, very long texts, and texts without letters or known n-grams.
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 -", None), (1003, "ЖЖ", None), (1004, "do an", "aa"), (1004, "do an", "aa")]
    rows += [(1005, "qu" * 30_000 + " zz", "cc"), (1006, "ba do " * 20_000, None), (1007, "AN ÖX", None)]
    docs = spark.createDataFrame([(*row, "x", 0.5) for row in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    found = sorted(tuple(r) for r in language.language_query(docs.repartition(3)).collect())
    expected = sorted(plain_languages(rows))
    assert len(found) == len(expected)
    for (name, held_out, lang, score), (other, held, langs, scores) in zip(found, expected):
        assert (name, held_out) == (other, held) and lang in langs, (name, lang, langs)
        # Scores differ by what the correction leaves of false positives only.
        assert abs(score - scores[langs.index(lang)]) < 1e-6
    assert sum(len(langs) == 1 for _, _, langs, _ in expected) > 0.8 * len(expected)
    assert len({r[2] for r in found}) == 4


@pytest.mark.parametrize("names", [["a", "b"], [f"l{i:02}" for i in range(40)]])
def test_slices_from_tasks_equal_those_at_hand(spark, monkeypatch, names):
    monkeypatch.setattr(language, "ROWS", 1 << 8)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("bcdfg") + rng.choice("aeiouäß") + rng.choice("klmnp") for _ in range(30)), rng.choice(names)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    counts, sizes = defaultdict(Counter), Counter(lang for _, _, lang in rows)
    for _, text, lang in rows:
        counts[lang].update(language.grams([text])[0].tolist())
    order = sorted(sizes, key=lambda lang: (-sizes[lang], lang))
    often = [(lang, g) for lang in order for g, n in counts[lang].items() if n >= 0.01 * sum(counts[lang].values())]
    plain = language.build([(lang, g) for lang in order for g in counts[lang]], order, often)
    found = language.learn(docs, share=0.01)
    assert found.languages == plain.languages
    assert found.masks.shape == plain.masks.shape and (found.masks == plain.masks).all()


def test_filter_stops_growing_and_still_holds_every_gram(monkeypatch):
    monkeypatch.setattr(language, "ROWS", 1 << 8)
    monkeypatch.setattr(language, "MASKS", 1 << 10)
    gram = np.arange(1000)
    model = language.build([("a", gram), ("b", gram[:5])], ["a", "b"])
    assert model.masks.size == 1 << 10
    held = np.bitwise_and.reduce([model.masks[r] for r in language._places(gram, len(model.masks))])[:, 0]
    assert (held & np.uint64(1)).all() and (held[:5] & np.uint64(2)).all()
    assert 0.5 < model.false_positives()[0] < 1 and model.false_positives()[1] < 0.01
