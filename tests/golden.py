"""Published results of one monitoring site, as fixed values: what the operators must give again."""

# date, day of year, measured area, expected area, z
SEASONAL = (
    ("2023-01-30", 30, 29.311, 32.325, -2.19),
    ("2023-04-15", 105, 24.106, 28.183, -2.85),
    ("2023-06-09", 160, 27.983, 29.71, -1.39),
    ("2023-07-09", 190, 29.801, 28.299, 0.62),
    ("2023-08-23", 235, 30.55, 30.35, -0.19),
    ("2023-10-22", 295, 33.829, 33.602, -0.17),
    ("2023-11-01", 305, 34.333, 32.736, 0.68),
    ("2023-12-06", 340, 32.404, 33.712, -1.13),
    ("2024-01-25", 25, 33.851, 32.459, 0.55),
    ("2024-03-20", 80, 31.475, 32.053, -0.67),
    ("2024-04-14", 105, 30.758, 28.183, 1.28),
    ("2024-05-24", 145, 30.402, 28.275, 1.0),
    ("2024-07-23", 205, 24.779, 27.051, -1.73),
    ("2024-08-12", 225, 27.774, 28.369, -0.69),
    ("2024-09-01", 245, 31.093, 32.597, -1.25),
    ("2024-10-31", 305, 28.782, 32.736, -2.77),
    ("2024-11-10", 315, 33.156, 32.434, 0.13),
    ("2025-01-19", 19, 33.52, 32.746, 0.16),
    ("2025-03-25", 84, 32.065, 31.55, 0.0),
    ("2025-05-09", 129, 22.082, 26.819, -3.26),
    ("2025-06-13", 164, 30.391, 29.882, 0.0),
    ("2025-08-17", 229, 31.871, 29.09, 1.41),
    ("2025-10-28", 301, 34.6, 33.028, 0.66),
    ("2025-11-25", 329, 33.912, 32.97, 0.27),
    ("2026-01-09", 9, 33.761, 33.402, -0.09),
    ("2026-02-13", 44, 33.545, 32.484, 0.34),
    ("2026-03-10", 69, 32.375, 32.892, -0.64),
    ("2026-04-04", 94, 31.561, 29.981, 0.67),
    ("2026-05-06", 126, 30.568, 26.719, 2.07),
)

# date, displacement in mm
DISPLACEMENT = (
    ("2023-02-09", 0.0),
    ("2023-03-05", -2.09),
    ("2023-04-10", -3.59),
    ("2023-05-04", -0.26),
    ("2023-06-21", -0.0),
    ("2023-07-15", -0.53),
    ("2023-08-08", -2.08),
    ("2023-09-01", -2.04),
    ("2023-10-07", -5.96),
    ("2023-11-12", -4.73),
    ("2023-12-06", -1.55),
    ("2024-02-28", -2.71),
    ("2024-03-11", -4.34),
    ("2024-04-04", -0.9),
    ("2024-05-22", -0.0),
    ("2024-06-15", -8.57),
    ("2024-08-14", -2.72),
    ("2024-09-07", 2.25),
    ("2024-10-01", -3.63),
    ("2024-11-06", -2.21),
    ("2024-12-12", -1.94),
    ("2025-01-05", -0.67),
    ("2025-03-18", -1.45),
    ("2025-05-05", -3.14),
    ("2025-07-16", -8.54),
    ("2025-08-09", -0.0),
    ("2025-09-02", -2.28),
    ("2025-10-08", -5.87),
    ("2025-11-01", -4.83),
    ("2025-12-07", -1.11),
    ("2026-01-12", -2.36),
    ("2026-02-05", -3.79),
    ("2026-03-25", -1.4),
    ("2026-04-06", -1.48),
    ("2026-05-24", -0.2),
    ("2026-06-05", 0.0),
    ("2026-07-06", 0.0),
)

# peak change in dB, area in square metres, score
SCORES = (
    (-20.84, 1800, 61.35),
    (-13.39, 3200, 46.82),
    (-17.99, 1200, 46.14),
    (-12.59, 3800, 46.12),
    (-11.5, 3900, 42.41),
    (-8.96, 8500, 39.93),
    (-14.28, 1200, 36.63),
    (-13.34, 1400, 36.12),
    (-11.96, 1600, 33.89),
    (-9.83, 3000, 33.76),
    (-9.6, 2600, 31.64),
    (-8.49, 2900, 28.87),
)
