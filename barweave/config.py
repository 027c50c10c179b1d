"""Settings of an experiment. Each field states its own range; ``ORDER`` states which must follow each other."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from datetime import date

#: Fields that must rise from one to the next.
ORDER = (("train_end", "val_start", "val_end", "test_start"), ("min_hold", "max_hold"), ("min_depth", "max_depth"), ("stop_loss", "trailing_stop"))
_ANY = float("inf")


def setting(default, least=None, most=None):
    """A field with the least and the greatest value that the queries can work with."""
    return field(default=default, metadata={"least": least, "most": most})


@dataclass(frozen=True)
class Config:
    """Defaults are fixed values of the trading rules and of the search."""

    train_end: str = "2022-12-31"
    val_start: str = "2023-01-01"
    val_end: str = "2023-12-31"
    test_start: str = "2024-01-01"
    min_hold: int = setting(5, 0)
    max_hold: int = setting(60, 1)
    cost: float = setting(0.0003 + 0.0002, 0, 0.5)
    stop_loss: float = setting(0.05, 0, 1)
    trailing_stop: float = setting(0.07, 0, 1)
    population: int = setting(5000, 1)
    generations: int = setting(100, 1)
    crossover: float = setting(0.70, 0.001, 0.999)
    mutation: float = setting(0.25, 0.001, 0.999)
    elite: int = setting(30, 0)
    tournament: int = setting(4, 1)
    min_depth: int = setting(2, 0)
    max_depth: int = setting(5, 1)
    max_nodes: int = setting(20, 1)
    patience: int = setting(25, 1)
    min_delta: float = setting(0.01, 0)
    seed: int = 42

    def validate(self) -> Config:
        """This object, if its values are usable; else an error that names every field that is not."""
        wrong = []
        for f in fields(self):
            value, least, most = getattr(self, f.name), f.metadata.get("least"), f.metadata.get("most")
            if isinstance(value, str):
                try:
                    date.fromisoformat(value)
                except ValueError:
                    wrong.append(f"{f.name} is no date")
            elif not (-_ANY if least is None else least) <= value <= (_ANY if most is None else most):
                wrong.append(f"{f.name} = {value} is out of range")
        for names in ORDER:
            wrong += [f"{a} must come before {b}" for a, b in zip(names, names[1:]) if not getattr(self, a) < getattr(self, b)]
        if self.crossover + self.mutation > 1 + 1e-12:
            wrong.append("crossover and mutation leave no share below 1")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self
