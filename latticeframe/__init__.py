"""latticeframe: distributed tensor algebra on Spark DataFrames.

    import latticeframe as lf
    a = lf.rand((1000, 64))
    np.einsum("ia,ib->ab", a, a)          # one join and one aggregation, nothing runs yet
"""

from .operators import blocked, contract, coords, elementwise, linalg, reduction
from .operators.blocked import BlockArray, BlockTensor, block_tensordot, from_blocks, to_blocks
from .operators.contract import dot, einsum, einsum_path, inner, kron, matmul, outer, tensordot, trace, vdot
from .operators.coords import astype, block, concatenate, ravel, reshape, split, stack, transpose
from .operators.elementwise import broadcast_to, operate
from .operators.linalg import schmidt, svd_matrix
from .operators.reduction import count_nonzero, cumprod, cumsum, scatter
from .operators.tensor import FUNCTIONS, Tensor
from .plans import cost, meta, planner
from .plans.meta import Meta
from .sources.create import array, empty, empty_like, from_table, from_vectors, full, full_like, identity, identity_block, ones, ones_like, rand, read, to_numpy, zeros, zeros_like

__version__ = "0.1.0"

__all__ = [
    "FUNCTIONS", "BlockArray", "BlockTensor", "Meta", "Tensor", "array", "astype", "block", "block_tensordot", "blocked", "broadcast_to", "concatenate", "contract", "coords", "cost", "count_nonzero", "cumprod", "cumsum",
    "dot", "einsum", "einsum_path", "elementwise", "empty", "empty_like", "from_blocks", "from_table", "from_vectors", "full", "full_like", "identity", "identity_block", "inner", "kron", "linalg", "matmul", "meta",
    "ones", "ones_like", "operate", "outer", "planner", "rand", "ravel", "read", "reduction", "reshape", "scatter", "schmidt", "split", "stack", "svd_matrix", "tensordot", "to_blocks", "to_numpy", "trace", "transpose",
    "vdot", "zeros", "zeros_like",
]
