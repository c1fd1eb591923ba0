"""Identifiers composed from bit fields, and what they are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Epoch and field widths of the 41/5/5/12 layout.
EPOCH_MS, SEQUENCE_BITS, WORKER_BITS, CENTRE_BITS = 1288834974657, 12, 5, 5
#: Seconds since the day and widths of the 28/22/13 layout.
UID_EPOCH_S, UID_TIME_BITS, UID_WORKER_BITS, UID_SEQUENCE_BITS = 1716134400, 28, 22, 13


def snowflake(millis: Column, centre: Column, worker: Column, sequence: Column) -> Column:
    time = F.shiftleft((millis - EPOCH_MS).cast("bigint"), SEQUENCE_BITS + WORKER_BITS + CENTRE_BITS)
    place = F.shiftleft(centre.cast("bigint"), SEQUENCE_BITS + WORKER_BITS).bitwiseOR(F.shiftleft(worker.cast("bigint"), SEQUENCE_BITS))
    return time.bitwiseOR(place).bitwiseOR(sequence.cast("bigint"))


def snowflake_millis(c: Column) -> Column:
    return F.shiftright(c, SEQUENCE_BITS + WORKER_BITS + CENTRE_BITS) + EPOCH_MS


def with_gene(id_: Column, sequence: Column, user: Column, genes: int) -> Column:
    """An order number whose low bits are the user's; the sequence moves up by their width and may run into the
    worker's bits, as it does in the source of this layout. Not unique."""
    width = (genes - 1).bit_length()
    return id_.bitwiseOR(F.shiftleft(sequence.cast("bigint"), width)).bitwiseOR(F.pmod(user, F.lit(genes)).cast("bigint"))


def uid(seconds: Column, worker: Column, sequence: Column) -> Column:
    time = F.shiftleft((seconds - UID_EPOCH_S).cast("bigint"), UID_WORKER_BITS + UID_SEQUENCE_BITS)
    return time.bitwiseOR(F.shiftleft(worker.cast("bigint"), UID_SEQUENCE_BITS)).bitwiseOR(sequence.cast("bigint"))


def uid_parts(c: Column) -> tuple[Column, Column, Column]:
    """Seconds, worker and sequence."""
    seconds = F.shiftright(c, UID_WORKER_BITS + UID_SEQUENCE_BITS) + UID_EPOCH_S
    worker = F.shiftright(c, UID_SEQUENCE_BITS).bitwiseAND(F.lit((1 << UID_WORKER_BITS) - 1).cast("bigint"))
    return seconds, worker, c.bitwiseAND(F.lit((1 << UID_SEQUENCE_BITS) - 1).cast("bigint"))


class Layout:
    """Ids of 64 bits: a sign bit, time, worker and sequence, whose bits must fill them."""

    def __init__(self, time_bits: int, worker_bits: int, sequence_bits: int):
        if 1 + time_bits + worker_bits + sequence_bits != 64:
            raise ValueError("sign, time, worker and sequence must have 64 bits together")
        self.worker_shift, self.time_shift = sequence_bits, worker_bits + sequence_bits
        self.most_time, self.most_workers, self.most_sequence = ((1 << n) - 1 for n in (time_bits, worker_bits, sequence_bits))

    def allocate(self, time: Column, worker: Column, sequence: Column) -> Column:
        part = lambda c, n: F.shiftleft(c.cast("bigint"), n)
        return part(time, self.time_shift).bitwiseOR(part(worker, self.worker_shift)).bitwiseOR(sequence.cast("bigint"))


def base36(c: Column) -> Column:
    """A whole number in lower-case base 36."""
    return F.lower(F.conv(c.cast("string"), 10, 36))


def log2_floor(c: Column) -> Column:
    """The magnitude of a positive whole number in bits, from its binary digits, so that powers of two are exact."""
    return F.when(c > 0, (F.length(F.bin(c)) - 1).cast("bigint"))
