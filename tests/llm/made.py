"""Invented texts."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words(r, n):
    return [r.choice(WORDS) + str(r.randrange(40)) for _ in range(n)]
