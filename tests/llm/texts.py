"""Made-up words for tests."""


def words(rng, n, letters="aeinorst"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
