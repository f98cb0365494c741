"""Robot descriptions as tables, forward kinematics and dynamics of trees of joints as columns."""
