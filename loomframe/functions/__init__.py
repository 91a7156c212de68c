"""Column functions that Spark lacks, as expressions that stay in the JVM, and user-defined ones in Arrow batches."""

from loomframe.functions.aggregates import Aggregate, Spread, aggregated
from loomframe.functions.numbers import gcd, lcm
from loomframe.functions.tables import Thinned, thinned
from loomframe.functions.texts import tokens
from loomframe.functions.user import code_points, cogrouped_asof, extracted, moving_averages, nfc, word_counts
from loomframe.functions.vectors import cosine, dot, l2_distance, norm

__all__ = [
    "Aggregate", "Spread", "Thinned", "aggregated", "code_points", "cogrouped_asof", "cosine", "dot", "extracted", "gcd", "l2_distance", "lcm", "moving_averages", "nfc", "norm",
    "thinned", "tokens", "word_counts",
]
