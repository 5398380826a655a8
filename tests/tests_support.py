import random


def event_rows(n, seed=4):
    """Events with the image after them: seq, op, type, id, a."""
    chosen = random.Random(seed)
    rows = []
    for seq in range(n):
        op = chosen.choice(["set", "set", "set", "remove", "evict"])
        rows.append((seq, op, "t", str(chosen.randrange(20)), chosen.randrange(4) if op == "set" else None))
    return rows
