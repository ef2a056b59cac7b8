"""Plain versions that the tests hold results against."""


def reach(nodes, links):
    """The least node that each one reaches."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
