from collections import Counter, defaultdict

from cases import lines, prose

from loanloom.llm import line_dedup, mixing, quality


def brute_lines(rows, min_lines=3, min_words=50):
    """Texts without the runs that occurred before, rows in the order given."""
    seen, out = set(), []
    for text in rows:
        all_lines = text.split("\n")
        worded = [(i, line.strip()) for i, line in enumerate(all_lines) if line.split()]
        bare = [line for _, line in worded]
        # line numbers among the worded ones of repeated stretches
        old, gone = [], set()
        for i, line in enumerate(bare):
            if len(line.split()) >= min_words:
                gone |= {i} if ("line", line) in seen else set()
                seen.add(("line", line))
            old.append(i + 1 < len(bare) and (line, bare[i + 1]) in seen)
            seen.add((line, bare[i + 1]) if i + 1 < len(bare) else None)
        for i in range(len(old)):
            for j in range(i, len(old)):
                if not old[j]:
                    break
                if j - i + 2 >= min_lines or sum(len(x.split()) for x in bare[i:j + 2]) >= min_words:
                    gone |= set(range(i, j + 2))
        if 0 < len(bare) < min_lines:
            gone |= set(range(len(bare))) if ("document", *bare) in seen else set()
            seen.add(("document", *bare))
        cut = sorted(gone)
        numbers = {worded[i][0] for i in cut}
        # blank lines between two deleted neighbours go with them, if one run covers both
        for i, j in zip(cut, cut[1:], strict=False):
            if j == i + 1 and old[i]:
                numbers |= set(range(worded[i][0], worded[j][0]))
        out.append("\n".join(line for i, line in enumerate(all_lines) if i not in numbers))
    return out


def test_runs_against_brute_force(spark):
    shared, boiler = lines(50, 7), "cookies\nprivacy"
    long_line = " ".join(prose(5, 60))
    texts = [lines(1, 5) + "\n" + shared, boiler + "\n" + shared + "\n" + lines(2, 5), lines(3, 4) + "\n" + boiler, lines(3, 2) + "\n\n" + lines(3, 4),
             long_line, "intro\n" + long_line + "\nend", shared, "\n".join(shared.split("\n")[1:4]), "a\n\nb\n \nc", "x\na\nb\nc\ny", "r\n" * 12]
    two, one = "\n".join(" ".join(prose(70 + i, 26)) for i in range(2)), " ".join(prose(80, 12))
    texts += [lines(21, 3) + "\n" + two, two + "\n" + lines(22, 3), two.replace("\n", "\n \n"), one, one + "\n", one + "\n" + lines(23, 3),
              one + "\nsee below", one + "\n\nsee below ", boiler, "cookies\nprivacy\nterms", lines(24, 2) + "\n" + boiler]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = dict((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect())
    assert [out[i] for i in range(len(texts))] == brute_lines(texts)


def test_short_runs_and_short_copies_go(spark):
    two, one = "\n".join(" ".join(prose(70 + i, 26)) for i in range(2)), " ".join(prose(80, 12))
    texts = [lines(1, 4) + "\n" + two, two + "\n" + lines(2, 4), one, one, lines(3, 3) + "\ncookies\nprivacy", lines(4, 3) + "\ncookies\nprivacy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = dict((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect())
    assert [out[i] for i in range(6)] == [texts[0], lines(2, 4), one, "", texts[4], texts[5]]


def test_odd_documents_pass_line_dedup(odd, nothing):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    by_id = defaultdict(list)
    for r in out.collect():
        by_id[r["doc_id"]].append(r["text"])
    assert sorted(map(len, by_id[1])) == [0, len(lines(1, 8))]  # the second of two equal rows loses its lines
    assert by_id[2] == [""] and by_id[3] == [None] and by_id[6] == [lines(2, 6)]
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_targets_stop_at_twice_the_source(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 5), ("c", 0, 1), (None, 500, 2)], "source string, source_size long, docs long")
    out = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert out["a"] == 20 and out["c"] == 0 and abs(sum(out.values()) - 1.5 * 1510) < 1e-6
    assert out[None] == 1000 and abs(out["b"] - 1245) < 1e-9


def test_mix_takes_what_its_plan_says(odd, nothing):
    plan = mixing.mix_plan(odd).collect()
    assert len(plan) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in plan)
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    want = Counter()
    for r in plan:
        want[r["doc_id"]] += r["times"]
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == +want
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix_plan(odd.repartition(7)).collect()))
    assert mixing.mix(nothing).count() == 0


def test_taken_words_come_near_targets(documents):
    plan = mixing.mix_plan(documents).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in plan:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
    assert sum(taken.values()) <= sum(target.values()) + 1e-6


def test_text_counts():
    counts = quality.text_counts("a b c a b c\na b c a b c\n\n# $x")
    assert counts == {"n_words": 14, "word_chars": 15, "n_symbols": 2, "n_dup_lines": 1, "n_repeat_words": 12}
    assert set(quality.text_counts(None).values()) == {0}


def test_common_lines_deplete_documents(spark):
    boiler = "\n".join(" ".join(prose(900 + i, 20)) for i in range(4))
    rows = [(i, lines(i, 2 if i < 12 else 30) + "\n" + boiler, "h") for i in range(15)] + [(50, lines(77, 10), "h"), (51, boiler, "other")]
    rows += [(100 + i, lines(500, 10), "h") for i in range(30)]  # copies count once
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(out[i]["kept"] for i in range(12)) and all(out[i]["words_lost"] == 80 for i in range(15))
    assert all(out[i]["kept"] for i in (12, 13, 14, 50, 51, 100, 129))


def test_clean_texts_have_no_common_lines(spark, odd, nothing):
    boiler = [" ".join(prose(900 + i, 20)) for i in range(4)]
    own = {i: lines(i, 2 if i < 12 else 30).split("\n") for i in range(15)}
    texts = {i: "\n".join([boiler[0].upper(), *x[:1], "", boiler[1], *x[1:], *boiler[2:]]) for i, x in own.items()}
    rows = [(i, t, "h", "x") for i, t in texts.items()] + [(51, "\n".join(boiler), "other", "y"), (12, texts[12], "h", "z"), (None, texts[13], "h", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, removed string")
    out = quality.clean(docs)
    assert out.columns == docs.columns
    want = [(i, "\n".join([*own[i][:1], "", *own[i][1:]])) for i in (12, 12, 13, 14)] + [(51, "\n".join(boiler)), (None, "\n".join([*own[13][:1], "", *own[13][1:]]))]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(want)
    assert quality.clean(odd).columns == odd.columns and quality.clean(odd).count() == quality.judge(odd).where("kept").count()
    assert quality.clean(nothing).count() == 0


def test_odd_documents_are_judged(odd, nothing):
    out = quality.judge(odd).collect()
    assert len(out) == odd.count()
    assert all(r["base_failed"] for r in out if r["doc_id"] in (3, 4, 5, 9, 11))
    assert quality.judge(nothing).count() == 0
