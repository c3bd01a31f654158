import datetime as dt

DAY0 = dt.date(2000, 1, 1)


def day(i, start=DAY0):
    return start + dt.timedelta(days=i)


def close(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
