import random

from lexiloom.llm import linededup as L
from tests.llm.cases import documents, rows


def pieces(line):
    """The line cut behind marks and blanks, character by character."""
    def cut(text, ends):
        out, now = [], ""
        for i, c in enumerate(text):
            now += c
            if ends(now, text[i + 1 : i + 2]):
                out.append(now)
                now = ""
        return out + ([now] if now else [])

    def sentence(now, after):
        body = now.rstrip(" ")
        if after == " " or not body:
            return False
        return (body != now and body[-1] in ".!?…;:|") or (body[-1] in "。！？" and (body != now or after not in tuple("。！？")))

    def word(now, after):
        return after != " " and now[-1] == " " and now.rstrip(" ")[-1:] in tuple("dghou37")

    return [x for piece in cut(line, sentence) for x in ([piece] if len(piece) <= L.LONG else cut(piece, word))]


def brute(data):
    """(doc_id, text, removed), window by window in (doc_id, position) order; rows of one doc_id are one document."""
    seen, later, gone = {}, {}, {}
    unique = {(i, t): None for i, t in data if i is not None and t is not None}
    for i, t in sorted(unique):
        full = []
        for line in t.split("\n"):
            own = [x.strip(" ") for x in pieces(line) if x.strip(" ")]
            full += [(x, len(own) == 1) for x in own]
        for w in range(len(full) - 2):
            key = tuple(x for x, _ in full[w : w + 3])
            if not all(whole for _, whole in full[w : w + 3]) and sum(map(len, key)) < L.LEAST:
                continue
            if seen.setdefault(key, (i, w)) != (i, w):
                later.setdefault(i, {}).update({x: True for x in range(w, w + 3)} if all(whole for _, whole in full[w : w + 3]) else {x: later.get(i, {}).get(x, False) for x in range(w, w + 3)})
        own, sizes = later.get(i, {}), [len(x) for x, _ in full]
        for x in own:
            a = b = x
            while a - 1 in own:
                a -= 1
            while b + 1 in own:
                b += 1
            if own[x] or sum(sizes[a : b + 1]) >= L.RUN:
                gone.setdefault(i, set()).add(x)
    out = []
    for i, t in data:
        if i is None or t is None:
            out.append((i, t, 0))
            continue
        kept, nth, removed = [], 0, 0
        for line in t.split("\n"):
            stay, units, lost = [], 0, 0
            for piece in pieces(line):
                units += bool(piece.strip(" "))
                nth += bool(piece.strip(" "))
                if piece.strip(" ") and nth - 1 in gone.get(i, ()):
                    lost += 1
                else:
                    stay.append(piece)
            removed += lost
            if not lost:
                kept.append(line)
            elif lost < units:
                kept.append("".join(stay).rstrip(" "))
        out.append((i, "\n".join(kept), removed))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    data = [(i, "\n".join(rng.choice(["a", "b", "c", "", "  ", "long line %d" % rng.randrange(6)]) for _ in range(rng.randrange(14)))) for i in range(80)]
    assert rows(L.deduplicated_lines(documents(spark, data))) == sorted(brute(data))


def test_passages_and_cases(spark):
    passage = "\n".join(f"shared line {i} of the passage" for i in range(9))
    data = [
        (5, f"start\n{passage}\nend five"), (3, f"{passage}\n\nonly here"), (7, passage), (7, passage), (8, None), (None, passage), (9, ""),
        (10, "a\nb"), (11, "a\nb"), (12, "x\nx\nx\nx"), (13, "\n".join(f"line {i}" for i in range(60_000))),
    ]
    df = documents(spark, data, clash=True)
    done = L.line_dedup(df)
    assert done.columns == df.columns and done.schema == df.schema
    got = {r["doc_id"]: r["text"] for r in done.select("doc_id", "text").collect()}
    assert got[3] == f"{passage}\n\nonly here" and got[5] == "start\nend five" and 7 not in got
    assert got[8] is None and got[None] == passage and got[9] == "" and got[10] == got[11] == "a\nb"
    assert got[12] == "x"
    assert got[13] == data[-1][1]
    assert all(r["n_chars"] == len(r["text"]) for r in done.where("text is not null").collect())


def test_empty(spark):
    assert rows(L.line_dedup(documents(spark, []))) == []


def test_pieces_make_up_the_line():
    rng = random.Random(8)
    for _ in range(300):
        line = "".join(rng.choice(["word ", "and ", "two", "end. ", "what!  ", "x; ", "字。", "！？ ", ". ", "  ", "x.y ", "three 37 ", "a?? ", "b | "]) for _ in range(rng.randrange(80)))
        assert "".join(L.pieces_of(line)) == line
        assert L.pieces_of(line) == pieces(line), line
        cps = L.K.codepoints(line)
        units = [x.strip(" ") for x in pieces(line) if x.strip(" ")]
        assert [line[a:b] for a, b in zip(*L._spans(cps)[:2])] == units, line


def test_passages_within_one_line_and_short_documents(spark):
    rng = random.Random(6)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)) + ". "
    passage = "".join(sentence(9) for _ in range(6))
    bare = " ".join("".join(rng.choice("abcdefghilmnopqrstuv") for _ in range(5)) for _ in range(70))
    data = [
        (1, f"{sentence(8)}{passage}{sentence(7)}"), (2, f"{sentence(5)}{sentence(6)}{passage}{sentence(8)}\nown line"), (3, passage.strip()),
        (4, f"{sentence(30)}{bare} end"), (5, f"{sentence(12)}{bare} other end of it"), (6, "Yes. No. Why."), (7, "Yes. No. Why."),
    ]
    got = {r["doc_id"]: r["text"] for r in L.line_dedup(documents(spark, data)).collect()}
    assert got[1] == data[0][1] and got[4] == data[3][1] and got[6] == got[7] == "Yes. No. Why."
    assert passage not in got[2] and len(got[2]) < len(data[1][1]) - len(passage) + 3 and got[2].endswith("\nown line") and 3 not in got
    assert len(got[5]) < len(data[4][1]) - 300
    assert rows(L.deduplicated_lines(documents(spark, data))) == sorted(brute(data))


def test_a_filter_that_is_full_loses_nothing(spark, monkeypatch):
    from lexiloom.llm import common

    rng = random.Random(5)
    data = [(i, "\n".join(f"line {rng.randrange(9)}" for _ in range(12))) for i in range(60)]
    want = sorted(brute(data))
    monkeypatch.setattr(common, "FILTER_LEAST", 64)
    monkeypatch.setattr(common, "FILTER_MOST", 64)
    assert rows(L.deduplicated_lines(documents(spark, data))) == want


def test_short_repeats_between_edits_stay(spark):
    """Runs of under RUN characters aren't cut out of near copies."""
    rng = random.Random(7)
    sentences = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(7)) + "." for _ in range(40)]
    sentences = [x[:29] + "." for x in sentences]
    edited = [x.replace(" ", " new ", 1) if i % 4 == 3 else x for i, x in enumerate(sentences)]
    data = [(1, " ".join(sentences)), (2, " ".join(edited)), (3, " ".join(edited[:4] + sentences[4:12] + edited[12:]))]
    got = {r["doc_id"]: r["text"] for r in L.line_dedup(documents(spark, data)).collect()}
    assert got[1] == data[0][1] and got[2] == data[1][1] and 3 not in got
