"""Table views: track observations, points, residuals, scalar series."""
