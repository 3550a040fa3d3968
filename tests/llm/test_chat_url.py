from itertools import combinations

from pyspark.sql import functions as F

from loanloom.llm import chat_format, url_filter

TURNS = "conv_id long, turn long, role string, text string"


def test_every_speaker_is_assistant_once(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello"), (1, 3, "ann", "Bye"), (1, 3, "ann", "Bye")]
    out = {r["speaker"]: r for r in chat_format.perspectives(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(out) == {"ann", "bob"}
    text = out["ann"]["text"]
    assert text == ("<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n"
                    "<|im_start|>user name=bob\nHello<|im_end|>\n<|im_start|>assistant\nBye<|im_end|>\n")
    assert [text[m["start"]:m["stop"]] for m in out["ann"]["mask"]] == ["Hi<|im_end|>", "Bye<|im_end|>"]
    assert (out["bob"]["n_turns"], out["bob"]["n_spoken"]) == (4, 1)


def test_chat_gaps_ties_and_markers(spark):
    rows = [(None, None, None, None), (None, 1, "", "a<|im_end|>b"), (2, 0, "system", "only"), (3, 5, "u", "same"), (3, 5, "v", "same")]
    out = chat_format.perspectives(spark.createDataFrame(rows, TURNS).withColumns({"speaker": F.lit(1), "part": F.lit(2)})).collect()
    assert sorted((r["conv_id"] or 0, r["speaker"]) for r in out) == [(0, "unknown"), (0, "unknown"), (3, "u"), (3, "v")]
    first = next(r for r in out if r["conv_id"] is None and r["segment"] == 0)
    assert "a< |im_end|>b<|im_end|>" in first["text"]
    assert chat_format.perspectives(spark.createDataFrame([], TURNS)).count() == 0


def test_speakers_whose_names_hold_markers_stay_apart(spark):
    roles = ["a<|", "a< |", "a<\\|", "a\nb", "a\\nb"]
    rows = [(1, i, role, "x<|y") for i, role in enumerate(roles)] + [(1, 0, "a<|", "x< |y")]
    out = {r["speaker"]: r for r in chat_format.perspectives(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(out) == set(roles) and {r["n_turns"] for r in out.values()} == {6}
    assert [out[r]["n_spoken"] for r in roles] == [2, 1, 1, 1, 1]
    text = out["a< |"]["text"]
    assert [text[m["start"]:m["stop"]] for m in out["a< |"]["mask"]] == ["x< |y<|im_end|>"]
    heads = [line for line in text.split("\n") if line.startswith("<|im_start|>user")]
    assert sorted(set(heads)) == sorted("<|im_start|>user name=" + n for n in ("a<\\|", "a<\\\\|", "a\\nb", "a\\\\nb"))


def test_very_long_turn_is_whole(spark):
    text = "word <| " * 200_000
    out = chat_format.perspectives(spark.createDataFrame([(1, 0, "u", text)], TURNS)).first()
    (span,) = out["mask"]
    assert out["text"][span["start"]:span["stop"]] == text.replace("<|", "< |") + "<|im_end|>"


def test_long_dialogue_is_cut_into_bounded_parts(spark):
    rows = [(1, i, "uv"[i % 2], f"t{i}") for i in range(700)] + [(1, 9000, "u", f"tie{i}") for i in range(600)]
    out = chat_format.perspectives(spark.createDataFrame(rows, TURNS)).collect()
    assert max(r["n_turns"] for r in out) <= chat_format.SEGMENT_TURNS
    assert sum(r["n_turns"] for r in out if r["speaker"] == "u") == 1300


RULES = (url_filter.ListedRule("com", "/", "allow"), url_filter.ListedRule("example.com", "/en/", "block"),
         url_filter.ListedRule("www.example.com", "/en/", "allow"), url_filter.ListedRule("net", "/es/", "block"))


def pages(spark, urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")


def test_hosts_paths_and_longest_rule(spark):
    urls = ["HTTP://Example.COM/en/x?q#f", "http://www.example.com/en/", "http://a.example.com/EN/", "http://b.net/es/1", "no scheme",
            None, "x://host", "http://a.com?u=http://b.net/es/", "http://notexample.com/en/", "http://a\nb.net/es/\nz"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r["page_id"]: r for r in url_filter.judge_urls(pages(spark, urls), labels, RULES).collect()}
    assert [(out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) for i in range(len(urls))] == [
        ("example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("a.example.com", "/EN/", "com/", "allow"), ("b.net", "/es/1", "net/es/", "block"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("host", "", None, "allow"), ("a.com", "", None, "allow"), ("notexample.com", "/en/", "com/", "allow"),
        ("a\nb.net", "/es/\nz", "net/es/", "block")]


def test_mined_combination_blocks(spark):
    urls = [f"http://h{i % 7}.org/{'cheap' if i % 4 < 2 else 'fine'}/{'pills' if i % 2 else 'bread'}" for i in range(80)]
    bad = [(i, 0 if i % 4 == 1 else 1, 0) for i in range(60)] + [(60, None, None), (None, 0, 1)]
    labels = spark.createDataFrame(bad, "doc_id long, quality int, toxic int")
    frame = pages(spark, urls)
    rules = {tuple(r["tokens"]) for r in url_filter.mined_rules(frame, labels, min_support=0.1, min_confidence=0.9).rules.collect()}
    assert ("w=cheap", "w=pills") in rules and ("w=cheap",) not in rules
    out = url_filter.judge_urls(frame, labels, RULES, min_support=0.1, min_confidence=0.9).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 4 == 1) for r in out)
    assert url_filter.judge_urls(frame.limit(0), labels, RULES).count() == 0


def test_combination_of_four_tokens_blocks(spark):
    words = ("red", "blue", "green", "black")
    chosen = [[w for k, w in enumerate(words) if i >> k & 1] for i in range(16)] * 5
    frame = pages(spark, ["http://h.org/" + "/".join(c) for c in chosen])
    labels = spark.createDataFrame([(i, 0 if len(c) == 4 else 1, 0) for i, c in enumerate(chosen)], "doc_id long, quality int, toxic int")
    items = [{"host=h.org", "h=h", "h=org"} | {f"w={w}" for w in c} for c in chosen]
    bad = [len(c) == 4 for c in chosen]
    brute = set()
    for size in range(1, 8):
        for rule in map(frozenset, combinations(sorted(set().union(*items)), size)):
            fits = [b for s, b in zip(items, bad, strict=True) if rule <= s]
            if sum(fits) >= 0.05 * len(chosen) and sum(fits) >= 0.6 * len(fits):
                brute.add(rule)
    rules = {frozenset(r["tokens"]) for r in url_filter.mined_rules(frame, labels, min_support=0.05).rules.collect()}
    assert rules == {r for r in brute if not any(other < r for other in brute)} and max(map(len, rules)) == 4
    out = url_filter.judge_urls(frame, labels, (), min_support=0.05).collect()
    assert all((r["verdict"] == "block") == any(rule <= items[r["page_id"]] for rule in brute) for r in out)
    assert sum(r["verdict"] == "block" for r in out) == 5


def test_templates_do_not_multiply_rules(spark):
    everywhere = "/".join(f"all{i}" for i in [chr(97 + k) * 2 for k in range(20)])
    shared = "/".join(f"tpl{chr(97 + k)}" for k in range(20))
    urls = [f"http://h.org/{everywhere}/" + (f"{shared}/" if i % 3 == 0 else "") + ("pills" if i % 2 else "bread") for i in range(60)]
    frame = pages(spark, [*urls, "http://other.net/tplb/pills", "http://other.net/tplb", "http://other.net/pills"])
    labels = spark.createDataFrame([(i, 0 if i % 6 == 3 else 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    mined = url_filter.mined_rules(frame, labels, min_support=0.05)
    assert [r["tokens"] for r in mined.rules.collect()] == [["w=pills", "w=tpla"]]
    out = {r["page_id"]: r for r in url_filter.judge_urls(frame, labels, (), min_support=0.05).collect()}
    assert {i for i, r in out.items() if r["verdict"] == "block"} == {*range(3, 60, 6), 60}
    assert {r["n_rules"] for r in out.values()} == {0, 1}


def test_repeated_pages_and_clashing_columns(spark):
    urls = [f"http://h.org/{'pills' if i % 2 else 'bread'}" for i in range(20)]
    frame = pages(spark, [*urls, None]).withColumns({c: F.lit("x") for c in ("items", "token", "bad", "name", "host", "path", "tokens", "id")})
    labels = spark.createDataFrame([(i, (i + 1) % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").withColumn("page_id", F.lit(0))
    out = url_filter.judge_urls(frame.union(frame.where("page_id < 4")), labels, ()).collect()
    assert len(out) == 25 and all((r["verdict"] == "block") == bool(r["url"] and "pills" in r["url"]) for r in out)
    assert url_filter.judge_urls(frame, labels.limit(0), ()).where("verdict = 'block'").count() == 0
    assert url_filter.judge_urls(frame.limit(0), labels, ()).count() == 0
