import numpy as np


def same(a, b) -> bool:
    return np.array_equal(np.asarray(a), np.asarray(b))


def close(a, b, **kwargs) -> bool:
    a, b = np.asarray(a), np.asarray(b)
    return a.shape == b.shape and np.allclose(a, b, **kwargs)
