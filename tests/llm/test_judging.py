import itertools
import math
import os
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from taskloom.llm import language, outliers
from taskloom.llm.decontamination import drop_contaminated, find_contamination
from taskloom.llm.language import codewords, fit_languages, held_out, identify_languages
from taskloom.llm.outliers import CUTOFF, judge_quality
from taskloom.llm.weak_labels import classify_quality, estimate_accuracies

from .conftest import EDGES, documents_frame

LANGUAGES = {
    "aa": ["kato", "mira", "lopa", "the", "rin", "sol"],
    "bb": ["zweig", "schloss", "und", "pfad", "tisch", "ich"],
    "cc": ["queño", "ción", "el", "mañana", "llano", "y"],
}


def text_in(lang, n, seed):
    random.seed(seed)
    return " ".join(random.choices(LANGUAGES[lang], k=n))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, text_in(lang, 6 + i % 30, i), lang, "s") for i, lang in enumerate(list(LANGUAGES) * 60)]
    rows += [(900, "1234 !!", "aa", "s"), (901, None, "bb", "s"), (902, "mira lopa", None, "s")]
    return documents_frame(spark, rows)


def test_languages_on_held_out_rows(labelled):
    model = fit_languages(labelled.filter(~held_out(labelled.doc_id)))
    rows = identify_languages(labelled.filter(held_out(labelled.doc_id)), model).collect()
    assert model.languages == ["aa", "bb", "cc"] and len(rows) > 30
    assert all(r.lang_pred == r.lang for r in rows if r.doc_id < 900)


def test_languages_on_edges(spark, labelled, edges, empty):
    model = fit_languages(labelled)
    rows = identify_languages(edges, model).collect()
    assert len(rows) == len(EDGES)
    assert all(r.lang_pred == "und" and r.score == 0 and not r.ambiguous for r in rows if r.doc_id in (1, 2, 3))
    assert all(0 <= r.score <= 1 for r in rows) and all(r.node == "node of row" for r in rows)
    assert identify_languages(empty, model).collect() == []
    nothing = fit_languages(empty)
    assert {r.lang_pred for r in identify_languages(edges, nothing).collect()} == {"und"}
    single = fit_languages(labelled.filter("lang = 'aa'"))
    assert {r.lang_pred for r in identify_languages(labelled.filter("doc_id < 9"), single).collect()} == {"aa"}


def test_number_characters_are_no_letters(spark, labelled):
    model = fit_languages(labelled)
    frame = documents_frame(spark, [(1, "²³ ½ ① Ⅷ 12 ٣"), (2, "aⅧ"), (3, "_!_")])
    got = {r.doc_id: r.lang_pred for r in identify_languages(frame, model).collect()}
    assert got[1] == got[3] == "und" and got[2] != "und"


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    rows = documents_frame(spark, [(i, "some words", f"l{i}", "s") for i in range(3)])
    with pytest.raises(ValueError):
        fit_languages(rows)


def test_executors_need_no_package(tmp_path):
    """Workers of a session started in another folder cannot import the package."""
    script = tmp_path / "run.py"
    script.write_text(
        "import sys\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})\n"
        "from taskloom.llm.language import fit_languages, identify_languages\n"
        "rows = spark.createDataFrame([(1, 'some words here', 'a'), (2, 'andere', 'b')], 'doc_id long, text string, lang string')\n"
        "print('rows', len(identify_languages(rows, fit_languages(rows)).collect()))\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 2" in done.stdout, done.stderr[-2000:]


def test_mixed_text_is_ambiguous(spark, labelled):
    model = fit_languages(labelled)
    frame = documents_frame(spark, [(1, "zz"), (2, "mira lopa kato")])
    got = {r.doc_id: r for r in identify_languages(frame, model).collect()}
    assert not got[2].ambiguous and got[2].score > 0.9
    assert got[1].score < got[2].score


def test_half_and_half_is_ambiguous_at_any_length(spark, labelled):
    model, rows, mixed = fit_languages(labelled), [], {}
    for n in (10, 30, 100, 1000):
        for a in LANGUAGES:
            rows.append((len(rows), text_in(a, 2 * n, n)))
            mixed[len(rows) - 1] = False
            for b in set(LANGUAGES) - {a}:
                rows.append((len(rows), f"{text_in(a, n, n)} {text_in(b, n, n + 1)}"))
                mixed[len(rows) - 1] = True
    got = {r.doc_id: r for r in identify_languages(documents_frame(spark, rows), model).collect()}
    assert {i: r.ambiguous for i, r in got.items()} == mixed
    assert all(got[i].score > 0.9 for i, m in mixed.items() if not m)


def test_codewords_differ():
    for n in (2, 4, 6, 9, 40):
        code = codewords(n)
        assert len({tuple(r) for r in code}) == n
        assert (np.abs(code.sum(axis=0)) < n).all()


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def statistics(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)


def test_statistics_on_edges(spark, edges, empty):
    rows = judge_quality(edges).collect()
    assert sorted(map(str, ((r.doc_id, *statistics(r)) for r in rows))) == sorted(
        str((d, *brute_statistics(t))) for d, t in EDGES
    )
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    # Too few rows for groups of their own: all are judged by the estimate over the table.
    distances = plain_distances([plain_axes(t) for _, t in EDGES])
    assert sorted((r.distance, r.kept) for r in rows) == [
        (pytest.approx(d, rel=1e-6), k) for d, k in sorted(
            (d, not brute_failed(t) and d <= CUTOFF) for d, (_, t) in zip(distances, EDGES)
        )
    ]
    assert judge_quality(empty).collect() == []


def brute_failed(text):
    n, _, _, _, repeated = brute_statistics(text)
    return n < 10 or 100 * repeated > 20 * n


def plain_axes(text):
    words, chars, symbols, same, repeated = brute_statistics(text)
    lines = len([x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)])
    parts = symbols / (chars + 1), same / (lines + 1), repeated / (words + 1)
    return [math.log(words + 1), math.log((chars + 1) / (words + 1)), *map(math.sqrt, parts)]


def plain_estimate(points, steps=6):
    """Mean, inverse scatter and determinant of one group, by loops over its points."""
    n, axes = len(points), range(5)
    cells = [sorted(math.floor(p[a] * 64) for p in points) for a in axes]
    at = {q: [c[math.ceil(q * n) - 1] / 64 for c in cells] for q in (0.25, 0.5, 0.75)}
    spread = [max(f, (h - x) / 1.349) for f, x, h in zip(outliers.FLOORS, at[0.25], at[0.75])]
    found = [(at[q], np.diag([1 / v**2 for v in (spread if wide else outliers.FLOORS)]), 0.0) for q, wide in outliers.STARTS]
    for step in range(steps):
        if step == 2:
            found = [min(found, key=lambda e: round(math.log(e[2]), 6))]
        found = [plain_step(points, *e[:2]) for e in found]
    return found[0]


def plain_step(points, mean, precision):
    weighed, bins = [], {}
    for p in points:
        off = [p[a] - mean[a] for a in range(5)]
        d = max(sum(off[i] * off[j] * precision[i][j] for i in range(5) for j in range(5)), 2.0**-20)
        bins.setdefault(math.floor(math.log2(d) * 16), []).append(p)
    left = 0.75 * len(points)
    for key in sorted(bins):
        share = min(1.0, left / len(bins[key]))
        weighed += [(share, p) for p in bins[key]]
        left -= share * len(bins[key])
        if left <= 0:
            break
    total = sum(w for w, _ in weighed)
    middle = [sum(w * p[a] for w, p in weighed) / total for a in range(5)]
    scatter = np.array([[sum(w * (p[i] - middle[i]) * (p[j] - middle[j]) for w, p in weighed) / total for j in range(5)] for i in range(5)])
    scatter = scatter * 1.41 + np.diag(np.square(outliers.FLOORS))
    return middle, np.linalg.inv(scatter), float(np.linalg.det(scatter))


def plain_distances(points, pool=None):
    mean, precision, _ = plain_estimate(pool or points)
    return [float((np.array(p) - mean) @ precision @ (np.array(p) - mean)) for p in points]


def test_distances_equal_the_plain_estimate(spark):
    """Own groups, a pool of small ones, and rows judged by all rows; whole results are equal."""
    rng = random.Random(28)
    rows = []
    for i in range(330):
        words = [f"w{rng.randrange(10 ** rng.randint(2, 6))}" for _ in range(rng.randint(12, 200))]
        if i % 17 == 0:
            words = [f"{w} |" for w in words]
        lang, source = ("en", "a") if i < 140 else ("en", f"s{i % 3}") if i < 200 else ("fr", "b") if i < 310 else ("de", "c")
        rows.append((i, " ".join(words), lang, source))
    got = {r.doc_id: r for r in judge_quality(documents_frame(spark, rows).repartition(5)).collect()}
    point = {r[0]: plain_axes(r[1]) for r in rows}
    for group, pool in ((range(140), range(140)), (range(140, 200), range(140, 200)), (range(200, 310), range(200, 310)), (range(310, 330), range(330))):
        found = plain_distances([point[i] for i in group], [point[i] for i in pool])
        assert [got[i].distance for i in group] == pytest.approx(found, rel=1e-6)
        assert [got[i].kept for i in group] == [not brute_failed(rows[i][1]) and d <= CUTOFF for i, d in zip(group, found)]


def test_the_least_determinant_is_near_the_least_of_all_subsets(spark):
    """Two clusters of different size: twelve of sixteen points, tried in all ways."""
    rng = random.Random(38)
    points = [[rng.gauss(0, 1) * f * 3 + (9 * f if i < 4 else 0) for f in outliers.FLOORS] for i in range(16)]
    frame = spark.createDataFrame([("g", 0, *p) for p in points], f"_group string, _part long, {', '.join(a + ' double' for a in outliers.AXES)}")
    found = outliers.estimates(frame).first()
    floors = np.diag(np.square(outliers.FLOORS))
    subsets = [np.array(x) for x in itertools.combinations(points, 12)]
    least = min(np.linalg.det(np.cov(x.T, bias=True) * 1.41 + floors) for x in subsets)
    assert found._determinant == pytest.approx(plain_estimate(points)[2], rel=1e-6)
    assert found._determinant < 1.05 * least


def test_outliers_go_and_ordinary_rows_stay(spark):
    random.seed(8)
    rows = []
    for i in range(400):
        text = " ".join(f"w{random.randrange(10**6)}" for _ in range(random.randint(40, 400)))
        if i % 20 == 0:
            text = " ".join(f"{w[:2]}### $$$" for w in text.split())
        rows.append((i, text, None if i % 3 else "en", "tiny" if i % 40 == 5 else "big"))
    got = {r.doc_id: r for r in judge_quality(documents_frame(spark, rows)).collect()}
    assert all(got[i].kept == bool(i % 20) for i in range(400))
    again = {r.doc_id: r.distance for r in judge_quality(documents_frame(spark, rows).repartition(7)).collect()}
    # Ten rows of one source are too few for an estimate of their own.
    assert all(abs(again[i] - got[i].distance) < 1e-6 * (1 + got[i].distance) for i in range(400))


def test_moderate_junk_goes_and_a_repeated_line_stays(spark):
    random.seed(18)
    assert abs(CUTOFF - 20.515) < 1e-3  # chi-square of five degrees, 0.999
    rows, gone = [], set()
    for i in range(300):
        words = [f"w{random.randrange(10**5, 10**6)}" for _ in range(random.randint(60, 300))]
        if i % 30 == 1:  # 6 to 7 % symbols
            words[::2] = [f"{w} |" for w in words[::2]]
            gone.add(i)
        if i % 30 == 2:  # 12.5 % symbols
            words = [f"{w} |" for w in words]
            gone.add(i)
        if i % 30 == 3:  # one symbol in a long text
            words[5] += "$"
        lines = [" ".join(words[k : k + 20]) for k in range(0, 60, 20)] + [" ".join(words[60:])]
        if i % 30 == 4:  # one line of five said twice
            lines.append(lines[0][:30])
            lines[0] = lines[0][:30]
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r for r in judge_quality(documents_frame(spark, rows)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == gone


def test_estimation_finds_the_accuracies():
    random = np.random.default_rng(9)
    truth = random.random(20_000) < 0.7
    right = [0.95, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(random.random(20_000) < 0.2, 1, np.where((random.random(20_000) < a) == truth, 2, 0)) for a in right], axis=1)
    patterns, counts = np.unique(votes @ (3 ** np.arange(4)), return_counts=True)
    posterior, share, tables = estimate_accuracies(patterns, counts.astype(float), 4)
    assert abs(share - 0.7) < 0.05
    assert np.allclose([t[1] for t in tables[0]], right, atol=0.06)


def test_quality_classifier(spark, edges, empty):
    random.seed(10)
    vocabulary = [f"{a}{b}" for a in "ba ke lo mi nu ra so ti".split() for b in "ran del mos tik pa".split()]
    good = [". ".join(" ".join(random.choices(vocabulary, k=9)).capitalize() for _ in range(9)) + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "### |" for w in random.choices(vocabulary, k=60)) for _ in range(50)]
    frame = documents_frame(spark, list(enumerate(good + bad)))
    got = {r.doc_id: r for r in classify_quality(frame).collect()}
    assert sum(got[i].kept for i in range(150)) >= 148 and sum(got[i].kept for i in range(150, 200)) <= 1
    rows = classify_quality(edges).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert classify_quality(empty).collect() == []


QUESTION = "A train from Paris leaves at 9 am and travels 120 km before it meets Anna who has walked 7 miles since noon"
OTHER = "A train from Berlin leaves at 5 am and travels 340 km before it meets Ruth who has walked 2 miles since noon"


def test_contamination(spark, edges, empty):
    items = spark.createDataFrame(
        [(1, QUESTION), (2, "short item of five words"), (3, None), (4, ""), (5, "too short"), (1, QUESTION)],
        "item_id long, text string",
    )
    twice = "Put 5 km in box one and then put 5 km in box two and go home at once please now"
    broken = twice.replace("5", "8", 1).replace("5", "9", 1)
    items = items.union(spark.createDataFrame([(6, twice)], items.schema))
    fill = " ".join(f"filler{i}" for i in range(50))
    rows = [
        (10, f"{fill} {QUESTION}. {fill}"),
        (11, f"{fill} {OTHER} {fill}"),
        (12, f"{fill} nothing in common {fill}"),
        (13, f"{fill}. Short item of five words! {fill}"),
        (14, f"{fill} {twice.replace('5', '8')}"),
        (15, f"{fill} {broken}"),
        (16, QUESTION.upper()),
        (10, f"{fill} {QUESTION}. {fill}"),
        (17, "too short"),
        (18, f"{broken} {fill} {twice}"),
    ]
    got = {(r.doc_id, r.item_id): r for r in find_contamination(documents_frame(spark, rows), items).collect()}
    assert set(got) >= {(10, 1), (11, 1), (13, 2), (14, 6), (18, 6), (17, 5)}
    assert not {d for d, _ in got} & {12}
    assert (15, 6) not in got or got[(15, 6)].n_windows < 3
    assert got[(10, 1)].n_changed == 0 and got[(11, 1)].n_changed >= 3 and got[(18, 6)].n_changed == 0
    frame = documents_frame(spark, rows)
    kept = drop_contaminated(frame, items)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} & {12, 17} == {12}
    assert drop_contaminated(edges, items).count() == len(EDGES)
    assert find_contamination(empty, items).collect() == []
    assert drop_contaminated(edges, items.limit(0)).count() == len(EDGES)


def found(spark, items, documents):
    items = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = find_contamination(documents_frame(spark, list(documents.items())), items).collect()
    return {(r.doc_id, r.item_id): (r.n_windows, r.n_changed) for r in got}


def test_copies_in_other_places_and_cases(spark):
    capital = "What is the capital city of France?"
    items = {1: QUESTION, 2: capital}
    documents = {
        20: f"filler words stand here {capital} and more",
        21: f"filler words stand here {capital.replace('France', 'Peru')} and more",
        22: QUESTION.upper(),
        23: f"so {QUESTION.lower()} it goes",
        24: "filler words stand here What is the colour city of France",
    }
    n = len(QUESTION.split()) - 12
    assert found(spark, items, documents) == {
        (20, 2): (1, 0), (21, 2): (1, 1), (22, 1): (n, 0), (23, 1): (n, 0)
    }


def test_copies_with_few_literal_words(spark):
    numbers = " ".join(f"{i} and {i + 1} or" if i % 3 == 0 else f"{i} {i * i}" for i in range(20, 36))
    items = {1: "What is 12 times 7?", 2: "Add 4 km and 5 km twice", 3: numbers, 4: "+ - * / ="}
    documents = {
        20: "he asked what is 12 times 7 today",
        21: "what is 13 times 8",
        22: "please Add 4 km and 5 km twice now",
        23: f"table {numbers} end",
        25: "now + - * / = then",
        26: "he adds 4 km and 5 km once",
    }
    n = len(numbers.split()) - 12
    assert found(spark, items, documents) == {
        (20, 1): (1, 0), (21, 1): (1, 2), (22, 2): (1, 0), (23, 3): (n, 0), (25, 4): (1, 0)
    }


def test_items_of_one_to_four_words_where_they_stand_alone(spark):
    items = {1: "Photosynthesis", 2: "Name three", 3: "Who wrote Hamlet?", 4: "What is 12 squared", 5: "..."}
    documents = {
        30: "photosynthesis",
        31: "We speak of photosynthesis here. Photosynthesis!",
        32: "first line\nname three\nlast line",
        33: "please name three of them",
        34: "Once more: who wrote Hamlet? Nobody knows.",
        35: "the man who wrote hamlet died",
        36: "what is 12 squared",
        37: "what is 13 squared",
        38: "name\nthree",
        39: "wait ... what",
        40: "...",
    }
    got = found(spark, items, documents)
    assert got == {k: (1, 0) for k in [(30, 1), (31, 1), (32, 2), (34, 3), (36, 4), (38, 2), (40, 5)]}


def test_items_with_values_drawn_anew_are_found(spark):
    random.seed(4)
    words = [f"{a}{b}" for a in "ba ce di fo gu la me ni po ru".split() for b in "na ter lis mon vek dra shi tol".split()]
    names = "Anna Peter Maria Ruth Omar Lena Paris Berlin Lima Oslo".split()
    items, documents = {}, {}
    for i in range(60):
        plain = random.choices(words, k=random.choice([5, 7, 10, 13, 20, 30]))
        slots = random.sample(range(1, len(plain)), max(1, len(plain) // 6))
        twice = []
        for _ in range(2):
            filled = list(plain)
            for s in slots:
                filled[s] = str(random.randint(2, 999)) if s % 2 else random.choice(names)
            twice.append(" ".join(filled))
        items[i], fill = twice[0], [" ".join(random.choices(words, k=40)) for _ in range(2)]
        documents[i] = f"{fill[0]}. {twice[1]}. {fill[1]}"
    assert set(found(spark, items, documents)) == {(i, i) for i in range(60)}


def test_values_may_become_equal_and_a_conflict_is_local(spark):
    head = "the farmer puts 3 red apples and 5 green pears into the large basket today"
    rest = " ".join(f"word{i}" for i in range(40))
    items = {1: head, 2: f"{rest} {head}", 3: f"{rest} {head.replace('5', '3')}"}
    equal, torn = head.replace("3", "4").replace("5", "4"), head.replace("3", "8").replace("5", "9")
    got = found(spark, items, {20: equal, 21: f"{rest} {torn}", 22: f"{rest} {equal}"})
    assert got[(20, 1)] == (3, 2)
    assert got[(22, 2)] == (43, 2)
    # One item value became two: windows with it do not count, the 40 copied words do.
    assert got[(21, 3)] == (31, 0)
