"""Plans that put operators together for the driver's tables and for projects."""
