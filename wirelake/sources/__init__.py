"""Where items come from and where tables go: payload readers (``payloads``) and stores (``store``)."""
