"""Optional adapters for libraries that dispatch by array type."""

from __future__ import annotations


def register_autoray() -> bool:
    """Let autoray-based contraction libraries use tensors; False if autoray is not installed."""
    try:
        import autoray
    except ImportError:
        return False
    from .operators.linalg import svd
    from .sources.create import to_numpy

    autoray.register_function("latticeframe", "to_numpy", to_numpy)
    autoray.register_function("latticeframe", "linalg.svd", lambda a: svd(a, full_matrices=False))
    return True
