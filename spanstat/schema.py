"""Interval columns, genome sizes and size classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVALS = "sid int, chrom string, start long, stop long"
#: Base pairs of a coverage bin.
BIN = 100
U32_MAX = 4294967295

# Chromosome sizes of hg38.
HG38 = {
    "chr1": 248956422,
    "chr2": 242193529,
    "chr3": 198295559,
    "chr4": 190214555,
    "chr5": 181538259,
    "chr6": 170805979,
    "chr7": 159345973,
    "chr8": 145138636,
    "chr9": 138394717,
    "chr10": 133797422,
    "chr11": 135086622,
    "chr12": 133275309,
    "chr13": 114364328,
    "chr14": 107043718,
    "chr15": 101991189,
    "chr16": 90338345,
    "chr17": 83257441,
    "chr18": 80373285,
    "chr19": 58617616,
    "chr20": 64444167,
    "chr21": 46709983,
    "chr22": 50818468,
    "chrX": 156040895,
    "chrY": 57227415,
}


def bins_of(size: int) -> int:
    return -(-size // BIN)


def genome_map(genome: dict[str, int], of: Column) -> Column:
    """The size of the chromosome ``of``, null where the genome has none."""
    pairs = [F.lit(x) for k, v in genome.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs).cast("map<string,bigint>"), of)


@dataclass(frozen=True)
class LayerConfig:
    """Exponential size classes: below min_size, then growing by growth_factor."""

    min_size: int = 128
    growth_factor: int = 4

    def max_size(self, layer: int) -> int:
        return min(self.min_size * self.growth_factor**layer, U32_MAX)

    def tile_size(self, layer: int) -> int:
        return max(self.max_size(layer) // 2, 1)

    def thresholds(self) -> list[int]:
        out, t = [], self.min_size
        while t <= U32_MAX:
            out.append(t)
            t *= self.growth_factor
        return out

    def layer(self, size: Column) -> Column:
        """The number of thresholds at or below ``size``."""
        steps = F.array(*[F.lit(t).cast("long") for t in self.thresholds()])
        return F.size(F.filter(steps, lambda t: t <= size)).cast("int")
