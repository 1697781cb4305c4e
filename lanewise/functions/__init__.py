"""Column functions: geometry, traffic levels, colours and clocks."""
