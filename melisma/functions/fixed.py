"""Fixed values of the notation and of tonal profiles."""

#: Semitones of the seven degrees above Do.
SCALE = [0, 2, 4, 5, 7, 9, 11]
#: Names of the pitch classes.
KEY_NAMES = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]
#: Weights of pitch classes above the tonic in major and minor keys (Krumhansl and Kessler).
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def rows(values: list, *names: str) -> str:
    """An inline SQL table (position, value) of a list."""
    shown = ", ".join(f"({i}, {v!r})" if isinstance(v, str) else f"({i}, CAST({v!r} AS DOUBLE))" for i, v in enumerate(values))
    return f"(VALUES {shown}) AS {names[0]}({', '.join(names[1:])})"
