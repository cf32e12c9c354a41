import random
import zlib

import numpy as np
import pytest

from vigilo.llm.common import shared_dir
from vigilo.llm.encode import Encoder
from vigilo.llm.token_files import TokenFile, read_token_files, write_token_files

from .helpers import awkward, empty

public_tokenizers = pytest.importorskip("public_tokenizers")
KINDS = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def library(name):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name,blank", KINDS)
def test_chunks_give_the_ids_of_the_whole_text(name, blank):
    pick = random.Random(3)
    signs = " \n\t\r  \x1c\x00aA bB.,'s'll 12é́İßﬁ<|endoftext|>½Ⅷ，中文😀‍　\x85\x0b"
    texts = ["".join(pick.choice(signs) for _ in range(pick.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(pick.choice(["a", "b ", " ", "\n", "x.", "'s", "\n\n"]) for _ in range(40)) for _ in range(1500)] + ["", "a" * 9000 + " b c" * 4000]
    whole = library(name)
    enc = Encoder(public_tokenizers.path(name), blank, memo_chunks=2000, segment_bytes=1000)
    for text, ids in zip(texts, enc.encode_all(t.encode() for t in texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_round_trip_in_order(spark):
    docs = awkward(spark)
    manifest = write_token_files(docs, shared_dir(spark, "t"), public_tokenizers.path("byte_bpe_50k.json"), 2, length=16, batch=4)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(manifest).collect())
    whole, texts = library("byte_bpe_50k.json"), {}
    for r in docs.collect():
        texts.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4"))
    at = 0
    for doc_id in sorted(texts):
        own = [g for g in got if g[0] == doc_id]
        assert sorted(g[2:] for g in own) == sorted((len(x), zlib.crc32(x.tobytes())) for x in texts[doc_id])
        for g in own:
            assert g[1] == at
            at += g[2]


def test_random_access_and_masks(spark):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(30)], "doc_id long, text string")
    manifest = write_token_files(docs, shared_dir(spark, "t"), public_tokenizers.path("byte_bpe_50k.json"), 2, length=8, batch=3)
    for r in manifest.collect():
        f = TokenFile(r.path)
        flat = f.span(0, r.n_tokens)
        masks = np.concatenate([f.mask(i) for i in range(r.n_sequences)])
        assert masks.sum() == r.n_tokens and masks[:r.n_tokens].all()
        for i in range(r.n_sequences):
            own = f.sequence(i)
            assert len(own) == 8 and not own.flags.owndata  # a view of the map
            assert own[:max(0, r.n_tokens - 8 * i)].tolist() == flat[8 * i:8 * i + 8].tolist()


def test_empty_table(spark):
    manifest = write_token_files(empty(spark), shared_dir(spark, "t"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert manifest.count() == 0 and read_token_files(manifest).count() == 0
