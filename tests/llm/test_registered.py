"""Registered queries without SQL over a whole table: token counts by a plain search, and encodings by the library."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.llm import bpe_codec, registry, token_counts
from tidewatch.llm.common import load

SF = "/root/testdata/sf0.001"


def test_op2_by_plain_search(spark):
    scores = token_counts.zipf_scores(token_counts.vocabulary_path(token_counts.VOCABULARY))
    worst, longest = token_counts.trie_of(token_counts.vocabulary_path(token_counts.VOCABULARY)).worst, max(map(len, scores))

    def tokens(word):
        best = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            found = []
            for i in range(max(0, j - longest), j):
                piece = word[i:j]
                if piece in scores:
                    found.append((round(best[i][0] - scores[piece], 9), best[i][1] + 1))
                elif j == i + 1:
                    found.append((round(best[i][0] - worst, 9), best[i][1] + len(piece.encode())))
            best.append(min(found))
        return best[-1][1]

    known = {}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in registry.QUERIES["op2_token_counts"](spark, SF).collect()}
    docs = load(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for r in docs:
        words = Counter(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        for w in words.keys() - known.keys():
            known[w] = tokens(token_counts.START + w)
        assert got[r.doc_id] == (sum(words.values()), sum(n * known[w] for w, n in words.items())), r.doc_id


def test_op8_by_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe_codec.vocabulary_path(bpe_codec.VOCABULARY))
    library.no_truncation()
    library.no_padding()
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.QUERIES["op8_bpe_codec"](spark, SF).collect()}
    docs = load(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))), r.doc_id


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "own", "own")], "doc_id long, text string, counts string, N_Words string")
    got = token_counts.token_counts(docs)
    assert got.columns == ["doc_id", "counts", "n_words", "n_tokens"] and got.filter(F.col("counts") == "own").first().n_words == 2
