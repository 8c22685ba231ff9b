"""Encoding, decoding and counting of tokens over a table of texts (see `bpe` for the method)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from shelfspan.llm import bpe
from shelfspan.llm.common import map_rows, small_batches, table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary file is; every machine has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", keep: bool = True, round_trip: str | None = None) -> DataFrame:
    """Adds `ids`: array<int> of each whole text's token ids, added tokens' strings as those tokens.

    With `round_trip` also a boolean column of that name: whether decoding the ids gives the text back.

    Null text is encoded as the empty text (an empty array). Rows, order and repeats stay as they are; an
    existing column of the name `ids` is replaced. One pass without a shuffle.
    """

    def make():
        encoder = bpe.load(path)
        piece = bpe.Remembered(encoder.encode_piece)

        def f(rows):
            out = []
            for t in rows[text]:
                got: list[int] = []
                for pieces, added in encoder.segments(t or ""):
                    for p in pieces:
                        got += piece[p]
                    if added is not None:
                        got.append(encoder.added[added])
                out.append(got)
            if not round_trip:
                return {ids: out}
            back = [encoder.decode(np.array(x, dtype=np.int64)).decode("utf-8", "replace") for x in out]
            return {ids: out, round_trip: [b == (t or "") for b, t in zip(back, rows[text], strict=True)]}

        return f

    return map_rows(df, [text], f"`{ids}` array<int>" + (f", `{round_trip}` boolean" if round_trip else ""), make, keep)


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded", keep: bool = True) -> DataFrame:
    """Adds `text`: the texts of array<int> column `ids`; bytes that aren't UTF-8 become U+FFFD. Null gives null."""

    def make():
        encoder = bpe.load(path)
        return lambda rows: {text: [None if x is None else encoder.decode(np.array(x, dtype=np.int64)).decode("utf-8", "replace") for x in rows[ids]]}

    return map_rows(df, [ids], f"`{text}` string", make, keep)


def round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids, and of the text decoded from them.

    What `encode` and `decode` give, digested where they are made, so ids aren't shipped. Null text counts
    as empty; a repeated row gives a repeated result; other columns are ignored.
    """

    def make():
        encoder = bpe.load(path)

        def known(p: str) -> tuple[str, bytes]:
            got = encoder.encode_piece(p)
            return ",".join(map(str, got)), np.array(got, dtype=np.int32).tobytes()

        piece = bpe.Remembered(known)
        added_as = {a: (str(i), np.array([i], dtype=np.int32).tobytes()) for a, i in encoder.added.items()}

        def f(rows):
            n, ids_sha, text_sha = [], [], []
            for t in rows[text]:
                parts: list[tuple[str, bytes]] = []
                for pieces, added in encoder.segments(t or ""):
                    parts += map(piece.__getitem__, pieces)
                    if added is not None:
                        parts.append(added_as[added])
                ids = np.frombuffer(b"".join([x[1] for x in parts]), dtype=np.int32)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([x[0] for x in parts]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            return {"doc_id": rows[doc_id], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

        return f

    return map_rows(df, [doc_id, text], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def count(df: DataFrame, path: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fitting_chars): token counts from prefix tables.

    `fitting_chars` is the length of the longest prefix that has at most `limit` tokens when it is encoded
    on its own. Null text counts as empty; a repeated row gives a repeated result; other columns are ignored.
    """

    def make():
        encoder = bpe.load(path)
        sizes = bpe.sizes_of(encoder)

        def f(rows):
            out: dict[str, list] = {"doc_id": rows[doc_id], "n_bytes": [], "n_tokens": [], "over_limit": [], "fitting_chars": []}
            for t in rows[text]:
                prefix = bpe.PrefixTokens(encoder, t or "", sizes)
                out["n_bytes"].append(len(prefix.text.encode()))
                out["n_tokens"].append(prefix.total)
                out["over_limit"].append(prefix.total > limit)
                out["fitting_chars"].append(prefix.fit(limit))
            return out

        return f

    return map_rows(df, [doc_id, text], "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long", make)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return count(table(spark, sf_dir, "documents"), vocabulary(), limit=1024)
