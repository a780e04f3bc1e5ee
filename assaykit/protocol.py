"""What a study fixes beforehand: signals, methods, weights, thresholds, budgets, seed. No literals elsewhere."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Protocol:
    signals: tuple[str, ...] = ("calibrated_confidence", "class_consistency", "localisation_stability")
    weights: tuple[int, int, int] = (89, 1, 10)
    budgets: tuple[int, ...] = (5, 10, 20)
    iou_thresholds: tuple[float, ...] = (0.5, 0.75)
    inclusion: float = 0.01
    seed: int = 24209199
    replicates: int = 10_000
    folds: int = 5
    classes: int = 9
    #: Half-open confidence bins, the last one closed.
    edges: tuple[float, ...] = (0.001, 0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 1.0)
    max_detections: int = 300
    tiers: dict[str, tuple[float, float, int | None]] = field(default_factory=lambda: {"A": (0.01, 0.99, None), "B": (0.02, 0.98, 6), "C": (0.03, 0.97, 6)})

    def __post_init__(self):
        if sum(self.weights) != 100 or min(self.weights) < 0:
            raise ValueError("weights are whole percentages that sum to 100")
        if list(self.edges) != sorted(set(self.edges)):
            raise ValueError("edges increase strictly")
        if not all(0 < b < 100 for b in self.budgets) or len(set(self.budgets)) != len(self.budgets):
            raise ValueError("budgets are different percentages between 0 and 100")
        if not all(0 < t <= 1 for t in self.iou_thresholds) or not 0 <= self.inclusion <= 1:
            raise ValueError("overlap thresholds and inclusion lie within the unit interval")
        if min(self.replicates, self.folds - 1, self.classes, self.max_detections) < 1 or self.seed < 0:
            raise ValueError("replicates, classes and detections are at least 1, folds 2, and seeds not negative")
        if len(set(self.signals)) != len(self.weights):
            raise ValueError("every signal has a weight")
        for mae, r, bits in self.tiers.values():
            if not (0 <= mae <= 1 and -1 <= r <= 1 and (bits is None or 0 <= bits <= 64)):
                raise ValueError("a tier bounds a difference, a correlation and a number of bits")
