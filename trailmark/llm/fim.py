"""Fill-in-middle: documents rearranged so that the middle comes last.

One scan of a batch's bytes by a table decides everything that depends on the
text: a state is what the last bytes mean for units and sentinels, and each
transition carries flags that are counted (a code point begins, a unit ended, a
sentinel is complete, a document ended).  A second pass looks up the cuts among
the flagged places.  Many stretches of the batch go through the table side by
side: the state depends on fewer bytes than the longest sentinel has, so each
stretch starts that many bytes early.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import quoted, text_batches

#: Units of a text, as the scan finds them.
UNIT_PATTERN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
END = 0xFF  # never a byte of UTF-8; stands between documents
NEW, SPACE, WORD = 0, 1, 2  # nothing read yet, in white space, in other bytes
CHAR, CUT, HIT, DONE = 1, 2, 4, 8  # flags of a transition
RESULT = "n long, form string, prefix_chars long, middle_chars long, output binary"


@dataclass(frozen=True)
class FimPlan:
    """Of each hundred texts ``plain`` stay as they are; of each hundred others
    ``spm`` have the suffix first.  No sentinel may hold white space, or its
    first character a second time; then none can arise where pieces meet.
    ``lanes`` stretches of a batch, of ``least`` bytes or more, go side by side.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 42
    plain: int = 50
    spm: int = 80
    lanes: int = 16_384
    least: int = 256

    def __post_init__(self) -> None:
        whole = [s.encode() for s in self.sentinels]
        if len(set(whole)) < 3 or not all(whole) or any(b in SPACES for s in whole for b in s):
            raise ValueError("sentinels must be three different strings without white space")
        if any(s[0] in t[1:] for s in whole for t in whole):
            raise ValueError("the first byte of a sentinel must occur nowhere else in one")
        if self.lanes < 1 or self.least < 1:
            raise ValueError("lanes and least must be 1 or more")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    @cached_property
    def warm_up(self) -> int:
        """Bytes that determine the state."""
        return max(len(s.encode()) for s in self.sentinels)

    @cached_property
    def table(self) -> np.ndarray:
        """``flags << 8 | next state`` by ``state << 8 | byte``.

        Beyond the first three, a state is the beginning of a sentinel that
        the last bytes spell.
        """
        whole = [s.encode() for s in self.sentinels]
        begun = sorted({s[:i] for s in whole for i in range(1, len(s))})
        number = {b"": WORD} | {b: WORD + 1 + i for i, b in enumerate(begun)}
        if len(number) + WORD > 255:
            raise ValueError("sentinels are too long")
        table = np.zeros((WORD + len(number), 256), np.uint16)
        for state in range(len(table)):
            spelt = begun[state - WORD - 1] if state > WORD else b""
            for byte in range(256):
                flags = 0 if byte == END or 0x80 <= byte < 0xC0 else CHAR
                if byte == END:
                    flags, after = DONE | (CUT if state != NEW else 0), NEW
                elif byte in SPACES:
                    flags, after = flags | (CUT if state >= WORD else 0), SPACE
                else:
                    now = spelt + bytes([byte])
                    if now in whole:
                        flags, now = flags | HIT, b""
                    # the first byte begins every sentinel and is nowhere else in one
                    after = number.get(now, number.get(bytes([byte]), WORD))
                table[state, byte] = flags << 8 | after
        return table.ravel()


def scan(data: bytes, plan: FimPlan) -> np.ndarray:
    """The flags of each byte of documents that each end with ``END``."""
    n, early = len(data), plan.warm_up
    lanes = max(1, min(plan.lanes, n // plan.least))
    steps = -(-n // lanes)
    padded = np.full(early + lanes * steps, END, np.uint8)
    padded[early : early + n] = np.frombuffer(data, np.uint8)
    columns = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (lanes, early + steps), (steps, 1)).T)
    flags = np.empty((steps, lanes), np.uint8)
    state, entry = np.zeros(lanes, np.uint16), np.empty(lanes, np.uint16)
    for i, column in enumerate(columns):
        np.left_shift(state, 8, out=state)
        np.bitwise_or(state, column, out=state)
        np.take(plan.table, state, out=entry, mode="clip")
        np.bitwise_and(entry, 0xFF, out=state)
        if i >= early:
            flags[i - early] = entry >> 8
    return flags.T.ravel()[:n]


def rearranged(texts: list[bytes], draws: np.ndarray, plan: FimPlan) -> pd.DataFrame:
    """``RESULT`` of each text, from its four ``draws`` (a row each)."""
    if not texts:
        return pd.DataFrame({"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []})
    end = bytes([END])
    data = end.join(texts) + end
    flags = scan(data, plan)
    ends = np.flatnonzero(flags & DONE)
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = np.flatnonzero(flags & CUT)
    before = np.searchsorted(cuts, starts)  # cuts of earlier documents
    n = np.searchsorted(cuts, ends, side="right") - before
    hits = np.flatnonzero(flags & HIT)
    plain = (starts == ends) | (np.searchsorted(hits, ends) > np.searchsorted(hits, starts)) | (draws[:, 2] % 100 >= 100 - plan.plain)

    # second pass: the byte after the k-th unit is the k-th cut
    first, second = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1).T
    place = lambda k: np.where(k > 0, cuts[np.minimum(before + np.maximum(k, 1) - 1, len(cuts) - 1)], starts) if len(cuts) else starts
    one, two = place(first), place(second)
    chars = np.flatnonzero(flags & CHAR)
    before_one, before_two, at_start = (np.searchsorted(chars, x) for x in (one, two, starts))
    spm = draws[:, 3] % 100 < plan.spm
    p, s, m = (x.encode() for x in plan.sentinels)
    outputs = []
    for text, a, b, c, asis, turned in zip(texts, starts.tolist(), one.tolist(), two.tolist(), plain.tolist(), spm.tolist(), strict=True):
        if asis:
            outputs.append(text)
            continue
        head, mid, tail = text[: b - a], text[b - a : c - a], text[c - a :]
        outputs.append(b"".join((s, tail, p, head, m, mid) if turned else (p, head, s, tail, m, mid)))
    count = lambda x: pd.Series(x).where(~plain).astype("Int64")
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return pd.DataFrame({"n": n, "form": form, "prefix_chars": count(before_one - at_start), "middle_chars": count(before_two - before_one), "output": outputs})


def draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers below 2^32 from a document's id; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def with_middle_last(docs: DataFrame, plan: FimPlan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``fim``: ``n`` units, ``form`` (plain, psm or spm),
    ``prefix_chars`` and ``middle_chars`` in code points (null if plain) and
    ``output``.

    All follows from the id and the text, so equal rows get equal results and
    reruns agree; rows of one id cut at the same draws.  A null text counts as
    empty and stays plain, as does one that holds a sentinel; a null id draws
    as the empty text would.  Texts are never shortened.  Other columns stay,
    whatever their names; one named ``fim`` is replaced.  An empty frame stays
    empty.  No row leaves its partition.
    """
    plan = plan or FimPlan()
    text_batches(docs.sparkSession)

    @pandas_udf(RESULT)
    def turn(text: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return rearranged([bytes(t) for t in text], np.column_stack([x.to_numpy(np.int64) for x in (a, b, c, d)]), plan)

    text = F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.withColumn("fim", turn(text, *draws(id_col, plan.seed)))
    return rows.withColumn("fim", F.col("fim").withField("output", F.col("fim.output").cast("string")))


def restored(output: Column, form: Column, plan: FimPlan | None = None) -> Column:
    """The text that ``with_middle_last`` turned into ``output``."""
    plan = plan or FimPlan()
    parts = F.split(output, "|".join(re.escape(s) for s in plan.sentinels), -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


# fixed values: the rules of the default plan, as SQL
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), k AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::UBIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::UBIGINT % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::UBIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::UBIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, array_to_string(u[1 : least(a, b)::BIGINT], '') AS x, array_to_string(u[least(a, b)::BIGINT + 1 : greatest(a, b)::BIGINT], '') AS y,
         array_to_string(u[greatest(a, b)::BIGINT + 1 : n::BIGINT], '') AS z
  FROM k
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(y) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
