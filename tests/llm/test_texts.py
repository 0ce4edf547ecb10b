"""Encoding, packing and residue."""

import base64
import random
from collections import Counter

import numpy as np
import pytest
import tiktoken

from edgeweft.llm import bpe, encoding, mail, packing, residue


@pytest.fixture(scope="module")
def reference():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = ["'", "s", "t", "re", "ll", "ve", "d", "m", " ", "  ", "\n", "\t", "\r\n", " ", " ", "é", "ß", "٣", "1", "23", "!", "?", "👍", "👩‍🔬", "́", "x", "ing", "\x00", "\x1c", "\x85", "漢", "<|endoftext|>", "The quick brown fox "]


def texts(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_pieces_are_exact(reference):
    made = texts(1, 3000, 40) + ["a" * 5000, " " * 3000, "x" * 3000 + " y", "'" * 50]
    ids, counts = bpe.encoder().encode([t.encode() for t in made])
    at = 0
    for t, n in zip(made, counts.tolist()):
        assert ids[at : at + n].tolist() == reference.encode_ordinary(t), t
        at += n
    assert bpe.encoder().encode([])[1].tolist() == []
    assert bpe.encoder().encode([b"", b""])[1].tolist() == [0, 0]


def test_classes_of_all_characters(reference):
    # one letter, number or space more or less would change the ids around it
    some = [chr(c) for c in range(0x20, 0x3000, 7)] + [chr(c) for c in range(0xFE00, 0x1F700, 61)]
    made = [f"a{c}b1{c}2 {c}{c} c" for c in some if not 0xD800 <= ord(c) < 0xE000]
    ids, counts = bpe.encoder().encode([t.encode() for t in made])
    parts = np.split(ids, np.cumsum(counts)[:-1])
    bad = [t for t, p in zip(made, parts) if p.tolist() != reference.encode_ordinary(t)]
    assert not bad


def test_chunks_cover_texts():
    made = [t.encode() for t in texts(2, 200, 400)]
    chunks, per_text = encoding.chunk_texts(made)
    at = 0
    for t, n in zip(made, per_text.tolist()):
        assert b"".join(chunks[at : at + n]) == t
        at += n
    shared = bytes(random.Random(3).choices(b"abcdefgh ", k=6000))
    mine, counts = encoding.chunk_texts([b"first " + shared, b"another beginning " + shared])
    assert len(set(mine[: counts[0]]) & set(mine[counts[0] :])) >= counts[0] - 2


def test_corpus_ids(spark, reference):
    shared = "".join(texts(4, 1, 900))
    made = texts(5, 120, 600) + [shared + t for t in texts(6, 40, 30)] + ["nospaces" * 2000, "", None, " ", "\n\n"] + ["same"] * 80
    data = [(i, t) for i, t in enumerate(made)] + [(3, "again"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as row").repartition(3)
    got = Counter((r.doc_id, tuple(r.ids)) for r in encoding.corpus_ids(df).collect())
    assert got == Counter((i, tuple(reference.encode_ordinary(t or ""))) for i, t in data)
    apart = Counter((r.doc_id, tuple(r.ids)) for r in encoding.corpus_ids(df, sharing=1).collect())
    assert apart == got
    assert encoding.corpus_ids(df.where("false")).count() == 0


def test_corpus_ids_of_a_large_vocabulary(spark, tmp_path):
    path = tmp_path / "large.tiktoken"
    ranks = [(bytes([b]), b) for b in range(256)] + [(b"ab", 70_000)]
    path.write_text("".join(f"{base64.b64encode(a).decode()} {b}\n" for a, b in ranks))
    text = "ab b\n" * 400
    got = encoding.corpus_ids(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), str(path)).first().ids
    assert got == [70_000, 32, 98, 10] * 400


def test_hilbert_curve_is_continuous():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = packing.hilbert_key(points, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    steps = np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_packing(spark, reference):
    rng = random.Random(8)
    data = [(i, "word " * rng.randint(0, 60)) for i in range(300)] + [(400, "long " * 950), (401, None), (402, ""), (402, "twice"), (None, "x y")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "0 as container")
    out = packing.packed(df, capacity=100, run=50).collect()
    sizes = Counter()
    for i, t in data:
        sizes[i] += len(reference.encode_ordinary(t or ""))
    got, filled = Counter(), Counter()
    for r in out:
        got[r.doc_id] += r.n_tokens
        filled[r.container] += r.n_tokens
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in sizes.items() if v} and set(got) == set(sizes)
    assert max(filled.values()) <= 100
    assert [r.part for r in sorted((r for r in out if r.doc_id == 400), key=lambda r: r.part)] == list(range(len([r for r in out if r.doc_id == 400])))
    assert sum(r.part > 0 for r in out if r.doc_id != 400) == 0
    assert len(filled) <= 1.02 * sum(sizes.values()) / 100 + 2
    assert packing.packed(df.where("false")).count() == 0


def test_pack_run():
    assert sorted(map(sorted, packing.pack_run([6, 4, 5, 5, 3], 10))) == [[0, 1], [2, 3], [4]]
    assert packing.pack_run([], 10) == []


def message(body, subject="Hello", kind="text/plain; charset=utf-8", encoding_name="7bit"):
    return f"From: a@b.example\nSubject: {subject}\nMIME-Version: 1.0\nContent-Type: {kind}\nContent-Transfer-Encoding: {encoding_name}\n\n{body}"


TALK = "We moved the count of the boxes to Thursday, and the keys are with the porter.\n\nPlease bring your own copy of the plan to the meeting."
CASES = [
    message("Dear {{first_name}},\n\nyour order left our depot."),
    message(TALK, subject="Your visit on [INSERT DATE HERE]"),
    message("Please enable JavaScript to view this message."),
    message("404 Not Found\n\nThe page you asked for could not be found on this server.\n\n--\nThis message is meant only for the people named above."),
    message("<html><body><p>Lorem ipsum dolor sit amet</p><p>consectetur adipiscing elit</p></body></html>", kind="text/html; charset=utf-8"),
    message(base64.b64encode("Fehler 500\nDie angeforderte Seite wurde nicht gefunden.".encode()).decode(), encoding_name="base64"),
    message("PLEASE ENABLE JAVASCRIPT TO VIEW THIS MESSAGE.\n\nOn 3 May 2024, X wrote:\n> " + TALK),
    "Dear ${Name},\r\n\r\nyour parcel left on ${shipDate}.",
]
NO_CASES = [
    message(TALK),
    message(TALK + "\n\nThe last mailing went out with {{first_name}} in the greeting, which is embarrassing; Ann has fixed the merge and 9 people get an apology."),
    message(TALK + '\n\nThe form said "Please enable JavaScript" until we updated the browser.'),
    message(TALK + "\n\nOn 3 May 2024, X wrote:\n> Please enable JavaScript to view this message."),
    message(TALK + "\n\nf = {k: v for k, v in pairs}\nthe set {a, b}", subject="[EXTERNAL] plan {draft 2}"),
    message("", subject=""), "", "   \r\n", None, message("the count of the boxes " * 20_000), "x" * 300_000,
]


def test_residue(spark):
    filler = [message(f"{TALK}\n\nNumber {i} of the list is at the depot with Ann {i % 7}.") for i in range(60)]
    every = CASES + NO_CASES + filler
    df = spark.createDataFrame(list(enumerate(every)), "doc_id bigint, text string").selectExpr("*", "'x' as subject", "1 as own", "2 as bucket")
    found = sorted(r.doc_id for r in residue.residue_documents(df).collect())
    assert found == list(range(len(CASES)))
    assert residue.residue_documents(df.where("false")).count() == 0
    assert residue.residue_documents(df.where("text is null")).count() == 0


def test_mail_parts():
    multi = message("--b\nContent-Type: text/plain\n\nplain =E2=82=AC\n--b\nContent-Type: text/html\n\n<p>html</p>\n--b--", kind='multipart/alternative; boundary="b"')
    assert mail.own_lines(mail.text_parts(multi)[1]) == ["plain =E2=82=AC"]
    quoted = message("caf=C3=A9 =\nlong", encoding_name="quoted-printable", subject="=?utf-8?b?w6TDtg==?=")
    subject, parts = mail.text_parts(quoted)
    assert subject == "äö" and mail.passages(mail.own_lines(parts)) == ["café long"]
    attached = message("--b\nContent-Type: text/plain\n\nmine\n--b\nContent-Type: application/octet-stream\nContent-Disposition: attachment\nContent-Transfer-Encoding: base64\n\nAAAA\n--b", kind="multipart/mixed; boundary=b")
    assert mail.own_lines(mail.text_parts(attached)[1]) == ["mine"]


def own(text):
    return mail.passages(mail.own_lines(mail.text_parts(text)[1]))


def test_text_below_and_between_quotes():
    below = message("On 3 May 2024, X wrote:\n> Please enable JavaScript.\n> \n> -- \n> X\n\nHi X,\n\nmine below.\n\n--\nsignature")
    assert own(below) == ["Hi X,", "mine below."]
    between = message("Hi,\n\nX <x@b.example>:\n| first\nanswer one\n| second\n\nanswer two\n\n***\nrule\n\nX <x@b.example>:\n| third\nanswer three")
    assert own(between) == ["Hi,", "answer one", "answer two", "answer three"]
    page = "<div>above</div>On 3 May 2024, X wrote:<blockquote>a<blockquote type=cite>b</blockquote>c</blockquote><p>below</p><blockquote>d</blockquote>end"
    assert own(message(page, kind="text/html")) == ["above", "below", "end"]
    assert own(message("<p>above</p><blockquote>a<blockquote>b</blockquote>c<p>d</p>", kind="text/html")) == ["above"]
    joined = message("Hi X,  On 3 May 2024, X wrote: > one >  > two  answer  >> three  end")
    assert own(joined) == ["Hi X, answer end"]
    assert own(message("mine\n\nOn 3 May 2024, X wrote:\n\nunmarked\n\nall theirs")) == ["mine"]
    assert own(message("mine\n\n-----Original Message-----\nFrom: X\n\ntheirs\n> older\n\ntheirs")) == ["mine"]
    assert own(message("write to\nX <x@b.example>:\nmine")) == ["write to X <x@b.example>: mine"]


def test_residue_below_a_quote(spark):
    quote = "On 3 May 2024, X wrote:\n> " + TALK.replace("\n", "\n> ") + "\n\n"
    made = [message(quote + "Dear {{first_name}},\n\nyour order left our depot."), message(quote + TALK), message("Hi,\n\n" + quote + "Please enable JavaScript to view this message.")]
    filler = [message(f"{TALK}\n\nNumber {i} of the list is at the depot with Ann {i % 7}.") for i in range(60)]
    df = spark.createDataFrame(list(enumerate(made + filler)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in residue.residue_documents(df).collect()) == [0, 2]


def index_of_even_words():
    return residue.Index(np.full(residue.BUCKETS, 3), 1000)


def test_placeholders_by_exemplars():
    index = index_of_even_words()
    for text in ("Dear {{unknownThing}},", "to <your postal code>", "an [Name der Firma]", "Betrag: %RECHNUNGSBETRAG_BETRAG%", "am {0} um", "Hi <% x.y %>", "le $date_commande$", "({anything} (colour goes here)"):
        assert index.open_slots(text) == 1, text
    for text in ("plan {draft 2}", "[EXTERNAL] plan", "{a, b} and a[i]", "x < 3 and y > 2", "100% of 5%", "a_b __init", "the [blue] one", "", "$HOME", "{}", "[]"):
        assert index.open_slots(text) == 0, text
    assert index.open_slots("The last mailing went out with {{first_name}} in the greeting, which is embarrassing.") == 0
    assert index.open_slots("Dear {{a}}, on {{b}}. The last mailing went out with {{c}} in the greeting, which is embarrassing.") == 2


def test_coverage_of_windows():
    index = index_of_even_words()
    every = ["404 Not Found", "", "the harvest of the orchard was good", "Zugriff verweigert. Bitte schalten Sie JavaScript ein.", "404 Not Found\n" + "apple pear plum " * 400, "___ -- ...", "lorem ipsum dolor " * 30_000]
    got = index.coverage(every)
    assert got[0] == got[3] == got[6] == 1 and got[1] == got[2] == got[5] == 0 and 0 < got[4] < 0.05
    *errors, other = index.coverage(["Zugriff verweigert Vorgangsnummer 12ab", "Connection refused (ticket 7781)", "Accès refusé\nRéférence : 88-12", "Ticket number 0 case reference number"])
    assert errors == [1, 1, 1] and other < residue.COVERED
    one = np.concatenate([index.coverage([x]) for x in every])
    assert np.allclose(got, one)
    assert [x for s in residue.blocks(["a" * 3_000_000] * 3 + ["b"]) for x in range(s.start, s.stop)] == [0, 1, 2, 3] and list(residue.blocks([])) == []


def test_multipart_marks():
    body = "pre\r\n--b\r\none --b two\r\n--b  \ntwo\n--bc\n--b--"
    assert mail._between(body, "--b") == ["pre", "\r\none --b two", "\ntwo\n--bc", ""]
    assert mail._between("--b\nx", "--b") == ["", "\nx"] and mail._between("x", "--b") == ["x"]
