"""Hierarchical best-fit packing of token sequences (operator 5)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veleta.llm.common import stored, text_of
from veleta.llm.tokenization import encode_ids

SEQUENCE = 1024
END_ID = 2
LEAF_ITEMS = 30_000  # items that one leaf packs
FAN_IN = 8  # groups that meet in one group of the next level
FULL_SHARE = 1.0  # bins filled to this share leave the tree at once

# An item is six longs in a row: doc_id, whether that is null, piece, start, length, crc32.
FIELDS = 6
BINS = "bin_group LONG, bin_no LONG, used LONG, items array<long>, offsets array<long>, done BOOLEAN"


def _encoded(path: str, sequence: int, end_id: int):
    """Per text: the number of its ids with the end id, then the crc32 of each piece."""
    end = int(end_id).to_bytes(4, "little")

    def encode(texts: pd.Series) -> list[list[int]]:
        out = []
        for ids in encode_ids(texts.tolist(), path):
            ids += end
            length = len(ids) // 4
            cuts = [0, *range(length % sequence or sequence, length + 1, sequence)]
            out.append([length, *(zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:]))])
        return out

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [encode(batch.iloc[i : i + 256]) for i in range(0, len(batch), 256)]
            yield pd.Series([x for part in parts for x in part], dtype=object)

    return run


def token_pieces(documents: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Ids of every whole text and one end id, cut into pieces of ``sequence`` tokens; only the first may be shorter."""
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    encoded = keyed.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row_key"), _encoded(tokenizer_path, sequence, end_id)("text").alias("ids"))
    first = F.pmod(F.get("ids", F.lit(0)) - 1, F.lit(sequence)) + 1
    pieces = encoded.select(
        "doc_id", "row_key", first.alias("first"), F.posexplode(F.slice("ids", F.lit(2), F.size("ids") - 1)).alias("piece", "ids_crc32"))
    return pieces.select(
        "doc_id", "row_key", "piece",
        F.when(F.col("piece") == 0, 0).otherwise(F.col("first") + (F.col("piece") - 1) * F.lit(sequence)).cast("long").alias("start"),
        F.when(F.col("piece") == 0, F.col("first")).otherwise(F.lit(sequence)).cast("long").alias("length"),
        "ids_crc32",
    )


def best_fit(lengths: list[int], room: int) -> list[int]:
    """Bin number of each item: longest first, each into the fullest bin that has room for it.

    Bins are kept by the room they have left, and a bit per room tells which lists hold one.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    present, bins, out = 0, 0, [0] * len(lengths)
    for i in order:
        n = lengths[i]
        fitting = present >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[left].pop()
            if not open_bins[left]:
                present ^= 1 << left
        else:
            chosen, left, bins = bins, room, bins + 1
        left -= n
        if left:
            open_bins[left].append(chosen)
            present |= 1 << left
        out[i] = chosen
    return out


def _merge(sequence: int, keep_open: int, last: bool):
    """Best fit of one group's bins, taken as items.

    Two bins of at most half a sequence always fit together, so after best fit at most one such bin is left in a
    group. A node of the tree can thus hand on as many small bins as there are leaves below it; each needs one host,
    and no fuller host serves where the emptiest do not. The emptiest ``keep_open`` bins are handed on, and the rest
    is final without loss.
    """

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["used", "order_key", "bin_no"], kind="stable").reset_index(drop=True)
        lengths = frame["used"].tolist()
        chosen = best_fit(lengths, sequence)
        n = max(chosen, default=-1) + 1
        used, items = [0] * n, [[] for _ in range(n)]
        for length, b, own in zip(lengths, chosen, frame["items"]):
            used[b] += length
            items[b].extend(own)
        emptiest = sorted((b for b in range(n) if used[b] < FULL_SHARE * sequence), key=lambda b: used[b])
        handed_on = set() if last else set(emptiest[:keep_open])
        offsets = [[0, *accumulate(own[4 : -FIELDS : FIELDS])] for own in items]
        return pd.DataFrame(
            {
                "bin_group": int(key[0]), "bin_no": range(n), "used": used, "items": items, "offsets": offsets,
                "done": [b not in handed_on for b in range(n)],
            }
        )

    return run


def pack(pieces: DataFrame, sequence: int = SEQUENCE, leaf_items: int = LEAF_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """Pack pieces into as few sequences as possible.

    Full pieces are sequences by themselves. The others are dealt to leaves by a hash of piece and row number and packed best-fit, longest
    first; full bins leave the tree, and underfull ones meet as items in the next level's groups until one group is left.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset. Rows with a null doc_id keep it.
    """
    pieces = stored(pieces, "pieces")
    short = pieces.filter(F.col("length") < sequence)
    groups = max(1, -(-short.count() // leaf_items))
    fields = [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "piece", "start", "length", "ids_crc32"]
    item = F.array(*[(F.col(f) if isinstance(f, str) else f).cast("long") for f in fields])
    level_rows = short.select(
        F.pmod(F.xxhash64("row_key", "piece", F.monotonically_increasing_id()), F.lit(groups)).alias("bin_group"),  # repeated rows spread
        F.col("row_key").alias("order_key"), F.col("piece").cast("long").alias("bin_no"),
        F.col("length").alias("used"), item.alias("items"),
    )
    levels, level, leaves = [], 0, 1
    while True:
        last = groups == 1
        packed = level_rows.groupBy("bin_group").applyInPandas(_merge(sequence, max(256, 2 * leaves), last), BINS)
        packed = stored(packed, f"bins-{level}")
        levels.append(packed.filter("done").withColumn("level", F.lit(level)))
        if last:
            break
        groups, leaves, level = -(-groups // fan_in), leaves * fan_in, level + 1
        level_rows = packed.filter(~F.col("done")).select(
            F.floor(F.col("bin_group") / fan_in).cast("long").alias("bin_group"),
            F.col("bin_group").alias("order_key"), "bin_no", "used", "items",
        )
    bins = levels[0]
    for other in levels[1:]:
        bins = bins.unionByName(other)
    # level (8 bits), group (32 bits), bin (22 bits): a leaf holds far fewer bins than that
    sequence_id = F.shiftleft(F.col("level").cast("long") + 1, 54) + F.shiftleft(F.col("bin_group"), 22) + F.col("bin_no")
    at = lambda i: F.get("items", F.col("place") * FIELDS + i)
    placed = bins.select(sequence_id.alias("sequence_id"), F.posexplode("offsets").alias("place", "offset"), "items").select(
        F.when(at(1) == 0, at(0)).alias("doc_id"), at(2).cast("int").alias("piece"), at(3).alias("start"),
        at(4).alias("length"), at(5).alias("ids_crc32"), "sequence_id", "offset",
    )
    # full pieces: a sequence each; the sign keeps their numbers apart from those of bins
    full = pieces.filter(F.col("length") == sequence).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return placed.unionByName(full)


def pack_documents(documents: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Tokenise and pack whole documents.

    A null text is an empty one and gives one piece holding the end id alone. Repeated rows are packed once each.
    An empty table gives no rows.
    """
    return pack(token_pieces(documents, tokenizer_path, sequence, end_id), sequence)
