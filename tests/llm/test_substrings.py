import random

import numpy as np
from hudlake.llm import shared, substrings as S

rng = random.Random(5)
say = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.getrandbits(24)) for _ in range(n))


def test_bands_are_tuned():
    b, r = S.tune(0.8, 0.95)
    assert 1 - (1 - 0.8**r) ** b >= 0.95 > 1 - (1 - 0.8**r) ** (b - 1)


def test_copies_share_an_anchored_block():
    for _ in range(300):
        p = say(S.MIN_WORDS)
        a, b = (S.units_of(f"{say(rng.randint(0, 60))} {p} {say(rng.randint(0, 60))}") for _ in range(2))
        assert set(a["b_hash"].tolist()) & set(b["b_hash"].tolist())


def test_sliding_picks():
    x = np.random.default_rng(0).integers(0, 99, 200)
    for w in (1, 2, 3, 31):
        assert S.sliding(x, w, np.minimum).tolist() == [min(x[i : i + w]) for i in range(200 - w + 1)]


def test_periodic_text_is_thinned():
    assert len(S.units_of("Is onhe. " * 3000)["b_start"]) < 6000 / S.REACH + 3


def test_band_collisions_find_near_paragraphs():
    hits = 0
    for _ in range(200):
        words = say(120).split()
        other = list(words)
        for i in rng.sample(range(120), 2):
            other[i] = "edited"
        a, b = S.units_of(" ".join(words)), S.units_of(" ".join(other))
        hits += bool(set(a["bands"].tolist()) & set(b["bands"].tolist()))
    assert hits > 190


def common(a, b):
    """Longest common run of words, by brute force."""
    best, row = (0, 0, 0), [0] * (len(b) + 1)
    for i in range(len(a)):
        new = [0] * (len(b) + 1)
        for j in range(len(b)):
            if a[i] == b[j]:
                new[j + 1] = row[j] + 1
                best = max(best, (new[j + 1], i + 1 - new[j + 1], j + 1 - new[j + 1]))
        row = new
    return best


def test_passages_and_paragraphs(spark):
    passage, shared_line, short = say(61), say(90), say(40)
    edited = shared_line.split()
    edited[45] = "Changed"
    texts = {
        1: f"{say(40)} {passage} {say(33)}", 2: f"{passage} {say(80)}", 3: f"{say(9)}\n{say(12)} {passage.upper()}", 4: say(300), 5: f"{short} {say(100)}", 6: f"{say(60)} {short}",
        7: f"{say(20)}\n{shared_line}\nend", 8: f"{' '.join(edited)}\n{say(30)}", 9: None, 10: "", 11: "one", 12: f"{say(70)}\n{say(70)}",
    }
    docs = spark.createDataFrame([(k, t, "en", 3) for k, t in texts.items()] + [(4, texts[4], "en", 3), (None, None, "en", 3)], "doc_id long, text string, s string, rid int")
    spans = shared.stage(S.removals(docs.select("doc_id", "text")), "spans")
    got = {(r.doc_id, r.s, r.e, r.of_doc_id) for r in spans.collect()}
    for d in (2, 3):
        n, i, j = common(texts[1].lower().split(), texts[d].lower().split())
        assert n >= 61 and (d, j, j + n, 1) in got
    assert {x[0] for x in got} == {2, 3, 8}
    out = {r.doc_id: r for r in S.remove(docs, spans).collect()}
    assert all(out[k].text == texts[k] for k in texts if k not in (2, 3, 8)) and out[1].s == "en"
    assert len(out[2].text.split()) == 80 and len(out[3].text.split()) == 21
    assert out[8].text.split() == texts[8].split()[90:]
    assert S.removals(docs.select("doc_id", "text").limit(0)).collect() == []


def test_every_long_repeat_is_found(spark):
    """Random documents with planted passages, against all pairs by brute force."""
    passages = [say(rng.randint(50, 90)) for _ in range(6)]
    texts = {i: " ".join(rng.choice([say(rng.randint(5, 60)), rng.choice(passages)]) for _ in range(4)) for i in range(40)}
    spans = S.removals(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    words = {k: t.split() for k, t in texts.items()}
    for r in spans:
        assert r.e - r.s >= 50
        if words[r.doc_id][r.s : r.e] != words[r.of_doc_id][r.of_s : r.of_s + r.e - r.s]:  # then paragraphs in one near component
            assert (r.s, r.e) == (0, len(words[r.doc_id])) and r.of_s == 0
            a, b = ({tuple(words[d][i : i + 5]) for i in range(len(words[d]) - 4)} for d in (r.doc_id, r.of_doc_id))
            assert len(a & b) >= 0.8 * len(a | b)
    text_of = {k: " ".join(w) for k, w in words.items()}
    for p in passages:
        holders = [k for k, t in text_of.items() if p in t]
        for k in holders[1:]:
            n = len(p.split())
            at = [i for i in range(len(words[k]) - n + 1) if words[k][i : i + n] == p.split()][0]
            assert any(r.doc_id == k and r.s <= at and r.e >= at + n for r in spans)


def test_cut():
    assert S.cut("a b  c\nd e", [(1, 3)]) == "a d e"
    assert S.cut(" a b", [(0, 2)]) == " "
    assert S.cut("é b ü", [(2, 3), (0, 1)]) == "b "


def test_all_members_of_a_band_are_compared(spark):
    """Chains of edits whose ends differ: whichever hash is lowest or highest, each links to its neighbours."""
    texts, rows = {}, 0
    for size in (12, 150):  # compared as pairs, and in blocks
        words = say(100).split()
        for _ in range(size):
            words = list(words)
            words[rng.randrange(10, 90)] = say(1)
            texts[rows], rows = " ".join(words), rows + 1
    sets = {k: np.unique(S.shingle_hashes(S.word_codes(S.split(t)))).view("i8") for k, t in texts.items()}
    keyed = [(k, int(k >= 12)) for k in texts]
    met = S.crowded(spark.createDataFrame(keyed, "h long, k long"))
    grams = spark.createDataFrame([(k, g.tolist()) for k, g in sets.items()], "h long, grams array<long>")
    groups = {r.node: r.component for r in shared.components(S.near(met, grams), "h", "other").collect()}
    assert groups == {k: 12 * (k >= 12) for k in texts}
    for i, j in ((0, 11), (12, 161)):
        assert len(np.intersect1d(sets[i], sets[j])) < 0.8 * len(np.union1d(sets[i], sets[j]))


def test_near_pairs_away_from_the_ends_of_a_band(spark):
    base = say(100).split()
    texts = {0: " ".join(base)}
    for k in range(1, 60):
        words = list(base)
        for i in rng.sample(range(5, 95), 2):
            words[i] = say(1)
        texts[k] = " ".join(words)
    h = {k: S.units_of(t) for k, t in texts.items()}
    bands = {k: set(u["bands"].tolist()) for k, u in h.items()}
    linked = {k for k in texts if k and bands[k] & bands[0]}
    spans = S.removals(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert linked <= {r.doc_id for r in spans if (r.s, r.e) == (0, 100)}


def test_passages_around_phrases_seen_earlier(spark):
    """All blocks of a passage occur earlier, apart: its later copies are removed all the same, and equal lines too."""
    texts, wanted = {}, {}
    for g in range(25):
        one, two = say(30), say(30)
        for k, middle in enumerate((f"{one} {say(40)}", f"{two} {say(40)}", f"{say(9)} {one} {two} {say(9)}", f"{say(20)} {one} {two} {say(7)}")):
            texts[10 * g + k] = f"{say(40)} {middle} {say(40)}"
        wanted[10 * g + 3] = (60, 120)
    phrase = say(25)
    for g in range(25):
        line = f"{say(14)} {phrase} {say(13)}"
        texts |= {1000 + 10 * g + k: f"{say(30)}\n{line}\n{say(30)}" for k in range(2)}
        wanted[1001 + 10 * g] = (30, 82)
    spans = S.removals(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    words = {k: t.split() for k, t in texts.items()}
    for r in spans:
        assert r.e - r.s >= 50 and words[r.doc_id][r.s : r.e] == words[r.of_doc_id][r.of_s : r.of_s + r.e - r.s]
    assert {r.doc_id: (r.s, r.e) for r in spans} == wanted and len(spans) == len(wanted)


def test_refrains_before_a_copy_leave_its_anchors(spark):
    """A few words inside a passage that also stand just before one copy of it cost no shared block."""
    for _ in range(300):
        p, refrain = say(S.MIN_WORDS + 2).split(), say(6)
        at = rng.randint(5, 40)
        p[at : at + 6] = refrain.split()
        p = " ".join(p)
        a = S.units_of(f"{say(40)} {p} {say(40)}")
        b = S.units_of(f"{say(40)} {refrain} {say(rng.randint(0, 3))} {p} {say(40)}".replace("  ", " "))
        assert set(a["b_hash"].tolist()) & set(b["b_hash"].tolist())


def test_copies_at_periodic_stretches(spark):
    """A passage that ends or begins in periodic text, longer beside one of its copies."""
    texts, wanted = {}, {}
    for g in range(30):
        beat = say(rng.randint(1, 9)).split()
        n = rng.randint(24, 45)
        tail, other = (beat * 60)[:n], say(52 - n).split()
        if g % 2:
            texts |= {2 * g: f"{say(40)} {' '.join(other + (beat * 60)[:n + 60])} {say(40)}", 2 * g + 1: f"{say(40)} {' '.join(other + tail)} {say(40)}"}
        else:
            back = (beat * 60)[-n - 60 :]
            texts |= {2 * g: f"{say(40)} {' '.join(back + other)} {say(40)}", 2 * g + 1: f"{say(40)} {' '.join(back[-n:] + other)} {say(40)}"}
        wanted[2 * g + 1] = set(range(40, 92))
    spans = S.removals(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    gone = {}
    for r in spans:
        gone.setdefault(r.doc_id, set()).update(range(r.s, r.e))
    assert all(wanted[k] <= gone.get(k, set()) for k in wanted)


def test_repeats_beyond_the_first_occurrence(spark):
    """Two documents share 60 words of which two earlier ones hold the first 36 and the last 36."""
    p = say(60).split()
    texts = {0: f"{say(30)} {' '.join(p[:36])}", 1: f"{' '.join(p[24:])} {say(30)}", 5: f"{say(11)} {' '.join(p)} {say(11)}", 6: f"{say(5)} {' '.join(p)} {say(9)}"}
    spans = S.removals(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert [(r.doc_id, r.s, r.e, r.of_doc_id, r.of_s) for r in spans] == [(6, 5, 65, 5, 11)]


def test_equal_short_paragraphs_are_one_component(spark):
    line, other = say(40), say(20)
    texts = {i: f"{say(30)}\n{line}\n{say(9)}" for i in range(5)} | {i: f"{say(12)}\n{other.upper()}" for i in (7, 9)} | {11: f"x {say(19)}", 12: say(19)}
    spans = S.removals(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.s, r.e, r.of_doc_id, r.of_s) for r in spans) == [(i, 30, 70, 0, 30) for i in range(1, 5)] + [(9, 12, 32, 7, 12)]
    assert len({r.component for r in spans if r.doc_id < 5}) == 1 and all(r.component is not None for r in spans)


def test_recall_of_links_among_boilerplate(spark):
    """Pairs of Jaccard similarity 0.8 and more among paragraphs that share much of their wording."""
    for shared_words, total in ((0, 120), (60, 120), (90, 130)):
        common_, texts = say(shared_words).split(), []
        for _ in range(250):
            own = say(total - shared_words).split()
            texts.append(" ".join(common_ + own))
            own[rng.randrange(5, len(own) - 5)] = "edited"
            texts.append(" ".join(common_ + own))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        staged = shared.stage(S.units(docs), "units")
        met = shared.stage(S.collisions(staged), "met")
        hashes = {r.doc_id: r.l_hash[0] for r in staged.collect()}
        sets = [np.unique(S.shingle_hashes(S.word_codes(S.split(t)))).view("i8") for t in texts]
        grams = spark.createDataFrame([(hashes[i], g.tolist()) for i, g in enumerate(sets)], "h long, grams array<long>")
        group = {r.node: r.component for r in shared.components(S.near(met, grams), "h", "other").collect()}
        pairs = [(i, i + 1) for i in range(0, 500, 2) if len(np.intersect1d(sets[i], sets[i + 1])) >= 0.8 * len(np.union1d(sets[i], sets[i + 1]))]
        found = sum(hashes[i] in group and group[hashes[i]] == group.get(hashes[j]) for i, j in pairs)
        assert len(pairs) == 250 and found >= 0.95 * len(pairs)


def test_clashing_columns_and_very_long_texts(spark):
    line, long = say(60), " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, f"{line}\n{long}", 5, 6, 7), (2, f"{say(9)}\n{line}", 5, 6, 7), (3, long, 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rid long, _spans long, component long")
    out = {r.doc_id: r for r in S.remove(docs, S.removals(docs)).collect()}
    assert out[1].text == rows[0][1] and out[2].text.split() == rows[1][1].split()[:9] and out[3].text == ""
    assert all(tuple(r)[2:] == (5, 6, 7) for r in out.values())


def test_only_compared_spots_ship_their_neighbours(spark):
    """Words beside a block go as text, which is compressed, and only with spots that are compared."""
    long, text = "y" * 5000, "one Two  three\nfour five six"
    docs = spark.createDataFrame([(1, text), (2, f"{long} a b {long}x")], "doc_id long, text string")
    rid = {r.doc_id: r.rid for r in docs.select("doc_id", S.row_hash().alias("rid")).collect()}
    spots = [(rid[1], 2, 4, True, False, False), (rid[1], 2, 4, False, False, True), (rid[1], 0, 6, False, True, False), (rid[1], 1, 3, False, False, True), (rid[2], 1, 3, False, True, False)]
    wanted = spark.createDataFrame([(*x, False) for x in spots], "rid long, s int, e int, own boolean, first boolean, whole boolean, crowd boolean")
    rows = S.looked_up(docs, wanted)
    got = {(r.rid, r.s, r.e): (r.left, r.right, r.grams is not None, r.own, r.first) for r in rows.collect()}
    assert got.pop((rid[1], 2, 4)) == ("two one", "five six", True, True, False)
    assert got.pop((rid[1], 0, 6)) == ("", "", False, False, True)
    assert got.pop((rid[1], 1, 3)) == (None, None, True, False, False)
    left, right, *_ = got.pop((rid[2], 1, 3))
    assert not got and left[0] == right[0] == "\t" and left != right and len(left) == len(right) == 33
    assert [r.n for r in rows.where("s = 0").select(S.F.size(S.words_of("left")).alias("n")).collect()] == [0]


def test_staged_neighbours_are_small(spark, tmp_path, monkeypatch):
    """The looked-up table takes fewer bytes a spot than the 62 words beside it as 64-bit hashes."""
    from pathlib import Path

    common = [rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("stuv") for _ in range(400)]
    plain = lambda n: " ".join(rng.choice(common) for _ in range(n))
    passages = [plain(60) for _ in range(150)]
    docs = spark.createDataFrame([(i, f"{plain(50)} {passages[i % 150]} {plain(50)}") for i in range(300)], "doc_id long, text string")
    sizes = []

    def drop(*staged):
        for df in staged:
            if "/around-" in df._staged_path:
                files = Path(df._staged_path.removeprefix("file://")).glob("*.parquet")
                sizes.append(sum(f.stat().st_size for f in files) / df.count())

    monkeypatch.setattr(shared, "drop_stage", drop)
    assert S.removals(docs).count() >= 150
    assert len(sizes) == 1 and sizes[0] < 62 * 8 * 0.8


def test_covering_tables_of_blocks_find_near_documents():
    """Pairs of similarity 0.8 share a covering table of their SimHashes; unlike ones hardly do."""
    g = np.random.default_rng(5)
    masks, blocks = S.covering(100_000)
    keep = np.array(masks, "u8")
    meet = lambda a, b: bool((((a ^ b)[:, None] & keep) == 0).any())
    near, far = 0, 0
    for _ in range(300):
        x = g.integers(0, 1 << 63, 250, dtype="u8")
        a, b = S.simhash_words(x[:225], blocks), S.simhash_words(x[25:], blocks)  # 200 of 250 shingles in common
        near += meet(a, b)
        far += meet(a, S.simhash_words(g.integers(0, 1 << 63, 225, dtype="u8"), blocks))
    assert near >= 297 and far <= 3
    for bits in ((0,), (0, 7, 20)):
        x = sum(1 << i for i in bits)
        assert any(not x & m for m in masks)


def crowd_of_texts(base: str, n: int, most: int) -> list[str]:
    """Copies of a text, in which up to ``most`` words differ."""
    out = []
    for i in range(n):
        words = base.split()
        for at in rng.sample(range(len(words)), i * most // n):
            words[at] = f"other{i}x{at}"
        out.append(" ".join(words))
    return out


def components_of(texts: list[str]) -> list[int]:
    """Smallest member of each text's component, by all pairs."""
    sets = [np.unique(S.shingle_hashes(S.word_codes(S.split(t)))) for t in texts]
    size, common = np.array([len(g) for g in sets]), S.overlaps(sets)
    link = np.triu(common >= 0.8 * (size[:, None] + size[None, :] - common), 1)
    return S.local_roots(len(texts), *np.nonzero(link)).tolist()


def test_a_crowd_of_near_copies_is_compared_once(spark, monkeypatch):
    """Near copies, many of them like no other, do not come up again in each of some hundred tables."""
    texts = crowd_of_texts(say(150), 700, 14) + crowd_of_texts(say(150), 60, 4) + [say(80) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, plain = {}, shared.stage

    def counted(df, name, *more):
        staged = plain(df, name, *more)
        rows[name] = rows.get(name, 0) + staged.count()
        return staged

    monkeypatch.setattr(shared, "stage", counted)
    found = {r.doc_id: r.component for r in S.near_documents(docs).collect()}
    want = components_of(texts)
    assert 100 < len(set(want)) < 800
    assert len({(found[i], want[i]) for i in found}) == len(set(found.values())) == len(set(want))
    assert rows["met"] < 40 * len(texts)  # 700 documents in 100 tables were 70,000 rows and more


def test_crowds_over_the_limit_and_late_members(spark, monkeypatch):
    """A crowd too large for one comparison goes by tables, and a table too large for one look goes whole; no link is lost."""
    monkeypatch.setattr(S, "MOST_CROWD", 20)
    monkeypatch.setattr(S, "CROWD", 16)
    texts = crowd_of_texts(say(150), 150, 14) + crowd_of_texts(say(150), 40, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component for r in S.near_documents(docs).collect()}
    want = components_of(texts)
    assert len({(found[i], want[i]) for i in found}) == len(set(found.values())) == len(set(want)) > 20


def test_candidates_of_tables_in_parts(monkeypatch):
    """Whatever batches the rows come in: pairs of small tables, documents of large ones, what is settled left out."""
    sizes = [1, 2, 5, 16, 17, 40, 3, 90, 2]
    monkeypatch.setattr(S, "TABLE_ROWS", 60)
    k = np.repeat(np.arange(len(sizes)) - 4, sizes).astype("i8")
    h = np.arange(len(k), dtype="i8") + 100
    label = np.zeros(len(k), "i8")
    label[k == 1] = 7  # a crowd but for two documents
    label[np.flatnonzero(k == 1)[:2]] = 0, 4
    label[k == 4] = 8  # one component
    x, y = np.zeros(len(k), "i8"), np.zeros(len(k), "i8")
    alone = np.flatnonzero(k == 0)[3]
    x[alone], y[alone] = -1, -1  # like no other in a table of 17
    pairs = {(a, b) for a in range(len(k)) for b in range(a + 1, len(k)) if k[a] == k[b] and sizes[k[a] + 4] <= 16 and k[a] != 4}
    large = {(int(h[i]), int(k[i]), 0) for i in range(len(k)) if k[i] in (0, 3) and i != alone}
    large |= {(int(h[i]), 1, 7) for i in np.flatnonzero(k == 1)[:2]}
    for step in (1, 7, 50, 500):
        found, out = S.Buckets(), []
        for at in range(0, len(k), step):
            out.append(found.add([c[at : at + step] for c in (k, h, x, y, label)]))
        out.append(found.end())
        rows = np.concatenate([np.stack(o) for o in out], axis=1).T.tolist()
        assert sorted((a, b) for a, b, _, _ in rows if b) == sorted((int(h[a]), int(h[b])) for a, b in pairs)
        assert sorted((a, t, c) for a, b, t, c in rows if not b) == sorted(large)
