"""What is decided on the driver before a job: specifications, audit, plan checks."""
