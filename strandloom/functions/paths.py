"""Column expressions over node paths and block names.

Block i has an entry node 2i and an exit node 2i+1; a path is an array of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flip(node: Column) -> Column:
    """The other side of the same block."""
    return node.bitwiseXOR(F.lit(1))


def block_of(node: Column) -> Column:
    return F.floor(node / 2).cast("int")


def is_block_edge(v1: Column, v2: Column) -> Column:
    return v1.bitwiseXOR(F.lit(1)) == v2


def node_sequence_to_path(nodes: Column) -> Column:
    """Adjacency constraint of a read: s0, s1^1, s1, ..., sm^1."""
    rest = F.flatten(F.transform(F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0))),
                                 lambda s: F.array(flip(s), s)))
    full = F.concat(F.slice(nodes, 1, 1), rest)
    return F.when(F.size(nodes) == 1, full).otherwise(F.slice(full, 1, F.size(full) - 1))


def node_adjacencies(nodes: Column) -> Column:
    """Adjacency steps a read crosses: (s[k-1], s[k]^1)."""
    return F.transform(
        F.arrays_zip(F.slice(nodes, 1, F.greatest(F.size(nodes) - 1, F.lit(0))).alias("a"),
                     F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0))).alias("b")),
        lambda p: F.struct(p["a"].alias("a"), flip(p["b"]).alias("b")))


def path_to_block_path(path: Column) -> Column:
    """Entry nodes of a path, closed by the exit of the last block."""
    entries = F.filter(path, lambda x, i: i % 2 == 0)
    return F.when(F.size(path) > 1, F.array_append(entries, flip(F.element_at(path, -1)))).otherwise(entries)


def is_reference_path(path: Column, n_genome_blocks: Column) -> Column:
    """Consecutive nodes with no inserted block."""
    straight = F.sequence(path[0], path[0] + F.size(path) - 1)
    return (path == straight) & (F.array_max(path) < n_genome_blocks * 2)


def reference_path(start: Column, end: Column) -> Column:
    """Path over blocks [start, end)."""
    return F.when(start < end, F.sequence(start * 2, end * 2 - 1)).otherwise(
        F.array().cast("array<int>"))


def insertion_path(start: Column, end: Column, at: Column, block: Column) -> Column:
    """Reference path with one novel block before block ``at``."""
    return F.concat(reference_path(start, at), F.array(block * 2, block * 2 + 1),
                    reference_path(at, end))


# fixed values: names of novel and translocated blocks, and the inversion mark
DE_NOVO, TRANSLOCATED, INVERTED = "_", "=", "'"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def block_name(idx: Column) -> Column:
    """A..Z, a..z, then a counter behind the letter."""
    idx = idx.cast("int")
    n = len(ALPHABET)
    letter = F.substring(F.lit(ALPHABET), idx % n + 1, F.lit(1))
    turn = F.floor(idx / n)
    return F.when(turn == 0, letter).otherwise(F.concat(letter, turn.cast("string")))


def block_index(name: Column) -> Column:
    """Inverse of :func:`block_name`; NULL for novel, translocated and inversion marks."""
    letter = F.instr(F.lit(ALPHABET), F.substring(name, 1, 1)) - 1
    turn = F.coalesce(F.substring(name, 2, 10).try_cast("int"), F.lit(0))
    return F.when(letter >= 0, letter + len(ALPHABET) * turn)


def path_to_string(path: Column, start: Column, first_novel: Column) -> Column:
    """Name of every visited block, ``'`` after inverted ones, ``_`` for novel ones.

    ``start`` is the block named A; blocks from ``first_novel`` on are novel.
    """
    exits = F.filter(path, lambda x, i: i % 2 == 1)
    return F.array_join(F.transform(exits, lambda x: F.concat(
        F.when(block_of(x) >= first_novel, DE_NOVO).otherwise(block_name(block_of(x) - start)),
        F.when(x % 2 == 0, INVERTED).otherwise(""))), "")


def reverse_path(path: Column) -> Column:
    """The same path seen from the other strand."""
    top = F.array_max(path)
    return F.reverse(F.transform(path, lambda x: top - x))


# fixed values: node paths of the named complex rearrangements
COMPLEX_TYPES = {
    "inv.del": (0, 1, 3, 2, 6, 7),
    "inv.2del": (0, 1, 5, 4, 8, 9),
    "trans": (0, 1, 4, 5, 2, 3, 6, 7),
    "trans.inv": (0, 1, 5, 4, 2, 3, 6, 7),
    "ddup": (0, 1, 2, 3, 4, 5, 2, 3, 6, 7),
    "invddup": (0, 1, 2, 3, 4, 5, 3, 2, 6, 7),
    "ddup.del": (0, 1, 2, 3, 4, 5, 2, 3, 8, 9),
    "invddup.del": (0, 1, 2, 3, 4, 5, 3, 2, 8, 9),
    "invddup.inv": (0, 1, 2, 3, 5, 4, 3, 2, 6, 7),
    "invddup.del.inv": (0, 1, 2, 3, 5, 4, 3, 2, 8, 9),
    "dup.del": (0, 1, 2, 3, 2, 3, 6, 7),
    "invdup": (0, 1, 2, 3, 3, 2, 4, 5),
    "dup.dup": (0, 1, 2, 3, 2, 3, 4, 5, 4, 5, 6, 7),
}


def complex_type(path: Column, has_novel: Column) -> Column:
    """Name of a simplified path, read in either direction; ``other`` when not listed."""
    key = lambda p: F.array_join(p.cast("array<string>"), ",")
    names = F.create_map(*[F.lit(v) for name, nodes in COMPLEX_TYPES.items()
                           for v in (",".join(map(str, nodes)), name)])
    found = F.coalesce(F.try_element_at(names, key(path)),
                       F.try_element_at(names, key(reverse_path(path))), F.lit("other"))
    return F.when(has_novel, F.lit("other")).otherwise(found)
