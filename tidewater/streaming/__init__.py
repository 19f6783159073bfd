"""Nothing here: the analytics this package offers have no streaming operator. Time enters only as the
exclusive ``as_of`` bound of batch scans."""
