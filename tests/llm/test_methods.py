"""What SQL can't express: against a library, brute force, round trips, held-out accuracy and known results."""

import html
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tidewatch.llm import bpe_codec, html_extract, jaccard_join, language_id, license_scan, registry, secret_scan, token_counts, warc_archive
from tidewatch.llm.common import load, words_of

SF = "/root/testdata/sf0.01"
ODD = ["", "   ", "Don't WE'LL it's", "<|endoftext|>x<|startoftext|>", "İstanbul ǅ ẞ", "école", "日本語 １２３ ½ ²", "hahahahahaha abababab", "\x1c\x1d x\x85y\xa0z", "😀👍🏽 ok", "ﬁ Å", "ΑΣ ΟΔΟΣ", "a_b-c__d", "x" * 500, "ªº µ", "<|"]


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    own = bpe_codec.WordTrie(bpe_codec.vocabulary_path(bpe_codec.VOCABULARY), max_nodes=5000, max_words=500)
    library = Tokenizer.from_file(bpe_codec.vocabulary_path(bpe_codec.VOCABULARY))
    library.no_truncation()
    library.no_padding()
    rng = random.Random(3)
    texts = [r.text for r in load(spark, SF, "documents").select("text").limit(300).collect()] + ODD
    texts += ["".join(rng.choice("abcdefghinorst'éèü019 .,!-_#\n") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.text(text) == (len(ids), " ".join(map(str, ids))) and own.decode(own.text(text)[1]) == library.decode(ids, skip_special_tokens=False), text


def test_bpe_decode(spark):
    docs = spark.createDataFrame([(1, "Hello the world"), (2, None), (3, "")], "doc_id long, text string")
    encoded = bpe_codec.bpe_encode(docs)
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe_codec.bpe_decode(encoded.drop("decoded")).collect()}
    assert got[1][1] == {r.doc_id: r.decoded for r in encoded.collect()}[1] and got[2] == ([], "") and got[3] == ([], "")


def test_token_counts_by_brute_force():
    scores = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.5, "ab": -3.5, "▁ab": -4.2, "ba": -3.9, "aba": -6.1, "▁b": -2.9}
    trie = token_counts.ForwardTrie(scores, max_nodes=50)

    def brute(word):
        best = None
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
            pieces = [word[i:j] for i, j in zip(at, at[1:])]
            if all(p in scores or len(p) == 1 for p in pieces):
                key = (-round(sum(scores.get(p, trie.worst) for p in pieces), 9), sum(1 if p in scores else len(p.encode()) for p in pieces))
                best = key if best is None or key < best else best
        return best[1]

    for n in range(1, 8):
        for letters in itertools.product("abé", repeat=n):
            word = token_counts.START + "".join(letters)
            assert trie.insert(word) == brute(word), word


def test_token_counts_grown_together():
    scores = {"a": -1.0, "b": -1.0, "ab": -2.0, "bé": -1.5, "aba": -3.0, "x\x00": -1.0}
    rng = random.Random(1)
    words = {"".join(rng.choice("abéx\x00€😀") for _ in range(rng.randrange(90))) for _ in range(2000)}
    for most in (64, 10_000):
        trie = token_counts.ForwardTrie(scores, max_nodes=most)
        assert trie.insert_all(list(words)) == {w: trie.cut(w) for w in words}
    few, tokens = token_counts.ForwardTrie(scores, max_words=1), lambda *ws: sum(trie.cut(token_counts.START + w) for w in ws)
    assert few.texts([None, "", "a a ab\x00b  c", "ab"]) == [(0, 0), (0, 0), (4, tokens("a", "a", "ab\x00b", "c")), (1, tokens("ab"))]


def test_token_counts_equal_unigram_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    scores = token_counts.zipf_scores(token_counts.vocabulary_path(token_counts.VOCABULARY))
    model = pb.ModelProto()
    model.pieces.add(piece="<unk>", score=0, type=2)
    for piece, score in scores.items():
        model.pieces.add(piece=piece, score=score, type=1)
    model.trainer_spec.model_type = 1
    model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.pad_id = 0, -1, -1, -1
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.escape_whitespaces = "identity", True, True
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    trie = token_counts.ForwardTrie(scores)
    words = "the quick brownish foxes jumped overwhelmingly internationalization erthinghe onblere naïve zzzzqq".split()
    assert [trie.insert(token_counts.START + w) for w in words] == [len(library.encode(w)) for w in words]


def test_language_held_out(spark):
    got = language_id.op9_language_id(spark, SF).join(load(spark, SF, "documents").select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)


def test_articles_of_all_pages(spark):
    def brute(page):
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S).group(1))
        return "\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split())))

    pages = {r.page_id: r.html for r in load(spark, SF, "pages").collect()}
    got = registry.QUERIES["op10_html_extract"](spark, SF).collect()
    assert len(got) == len(pages) and all(r.text == brute(pages[r.page_id]) and r.n_chars == len(r.text) for r in got)


def test_wrapper_has_optional_repeated_and_slots():
    pages = ["<ul><li>a<li>b</ul><p>x</p>", "<ul><li>c</ul><h2>n</h2><p>y</p><h2>m</h2><p>z</p>"]
    one, two = (html_extract.wrapper_of(html_extract.page_tree(p)) for p in pages)
    both = html_extract.merge(one, two)
    assert html_extract.expression(two) == "(ul(li(#)) (h2(#) p(#))+)"
    assert "li(#)+" in html_extract.expression(both) and "?" in html_extract.expression(both)
    assert html_extract.merge(one, one)["k"][0]["k"][0]["t"] == [4, 4, 0, None]


def test_layouts():
    page = '<header>x</header><div class="notice">n</div><article><header>H</header><h2>A &amp; B</h2><p>one <i>t</i>wo<p>three<ul><li>l1<li>l2</ul><div class="comments"><p>bad</p></div><form><p>f</p></form><aside>q</aside><script>"</article>"</script><p>end</article><p>no'
    assert html_extract.article_text(page) == "H\nA & B\none two\nthree\nl1\nl2\nend"


def test_archive_is_checked():
    record = warc_archive.record_bytes(7, "http://a.example/", b"payload", None)
    assert warc_archive.parse_record(zlib.decompress(record, 31))["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc_archive.parse_record(zlib.decompress(record, 31).replace(b"payload\r\n", b"paxload\r\n"))

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:7], self.data[7:]
            return out

    assert len(list(warc_archive.members(Stream(record * 3)))) == 3
    with pytest.raises(ValueError):
        list(warc_archive.members(Stream(record[:-5])))


def test_near_copies_in_large_groups(spark):
    """A group of near copies larger than a block: links and classes as by brute force."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"q{i}_{j}" for j in range(30)) for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words_of, texts)]
    links = [[j for j in range(len(sets)) if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(sets))]
    label = list(range(len(sets)))
    for _ in range(20):
        label = [min([label[i], *[label[j] for j in links[i]]]) for i in range(len(sets))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == {i: (label[i], len(links[i])) for i in range(len(sets))}


def test_shared_counts_in_parts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30_000, 9000)) for _ in range(6)]
    assert (jaccard_join.shared_counts(sets, sets) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()


def test_license_passages(spark):
    mit = dict(license_scan.PASSAGES)["mit"].split()
    cut = " ".join(mit[:10] + ["NEW"] + mit[10:])
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame([(1, "Intro. " + " ".join(mit).upper()), (2, cut), (3, " ".join(mit[:8]))], "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and got[1].score == 1.0 and (got[1].spans[0].start, got[1].spans[0].end) == (1, 1 + len(mit))
    assert got[2].labels == "mit" and len(got[2].spans) == 1 and got[3].labels == ""


def test_ownership(spark):
    pem = "see Bearer abcdefghij0123456789xyz end"
    rows = [(i, "token = sk" + "zq" * 8 if i < 30 else pem, f"s{i % 5}" if i < 30 else "own") for i in range(31)]
    got = {r.doc_id: r for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (got[0].n_live, got[0].n_copied) == (0, 1) and [s.kind for s in got[30].spans] == ["bearer"]
    red = {r.doc_id: r.text for r in secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert red[0] == "<assign>" and red[30] == "see <bearer> end"


def test_pipeline_by_brute_force(spark):
    """The stages on the smallest tables against plain Python for what each must drop, keep and change."""
    import corpus_pipeline

    small = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in load(spark, small, "documents").collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    from tests.oracle import connect

    db = connect(small)
    kept = {r[0] for r in db.sql(f"SELECT doc_id FROM ({registry.ORACLES['op4_quality_rules']}) WHERE kept").fetchall()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in kept if (w := words_of(docs[i].text))}
    label = {i: i for i in sets}
    for _ in range(10):
        for a in sets:
            for b in sets:
                if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    one = {i for i in label if label[i] == i}
    dirty = {r[0] for r in db.sql(f"SELECT doc_id FROM ({registry.ORACLES['op5_decontaminate']}) WHERE contaminated").fetchall()}
    assert set(got) == one - dirty
    trie = bpe_codec.trie_of(bpe_codec.vocabulary_path(bpe_codec.VOCABULARY))
    for i, r in got.items():
        base, _, _ = secret_scan.spans_of(docs[i].text)
        text, end, out = docs[i].text, 0, ""
        for start, _, kind, stop in base:
            if start >= end:
                out += text[end:start] + f"<{kind}>"
            end = max(end, stop)
        assert r.n_tokens == trie.text(out + text[end:])[0]
